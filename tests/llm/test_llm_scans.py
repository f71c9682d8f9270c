"""License, personal-data, language and secret scans."""

import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from fixtures import awkward, table, words  # noqa: E402

from memlake.llm import language, licenses, personal_data, secret_scan, spans, tagger  # noqa: E402

P = pytest.importorskip("public_tokenizers")

# the base patterns as they are stated, for comparison with the linear-time search
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_personal(t):
    digits = lambda m: sum(c.isdigit() for c in m)
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 14 <= digits(m.group()) <= 19 and spans.luhn(re.sub("[ -]", "", m.group()))],
        "phone": [m.span() for m in PHONE.finditer(t) if 10 <= digits(m.group()) <= 15],
    }


def plain_secrets(t):
    return {
        "assign": [m.span() for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32],
    }


def noise(alphabet, seed, n=4000):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_base_patterns_agree_with_the_stated_ones():
    for t in noise("ab.@-@ 1", 1) + noise("0127. -+()", 2) + noise(["1.2", ".255", "256", " ", "+1", "4111 1111 1111 1111", "a@b.c", "@"], 3):
        assert personal_data.base(t)[0] == plain_personal(t), t
    parts = ["token", "Secret", "PASSWD", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdefgh", "AKIA", "0123456789ABCDEF",
             "deadbeef" * 4, "/+_", "ſecret", "Key", "a", "é"]
    for t in noise(parts, 4):
        assert spans.secrets(t, spans.codes(t)) == plain_secrets(t), t


def test_joined_order_and_code_points():
    t = "𝒳 token=abcdefgh12 " + "a" * 40
    found = secret_scan.find(t, secret_scan.vocabulary(P.path("byte_bpe_50k.tiktoken")))
    assert spans.joined(found, secret_scan.KINDS) == "assign:2:18,hex:19:59"


def test_random_strings_are_found_and_identifiers_are_not():
    encoding = secret_scan.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    r = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hit = 0
    for _ in range(100):
        secret = "".join(r.choice(alphabet) for _ in range(32)) + "7a"
        t = f"the value {secret} is here"
        hit += secret_scan.find(t, encoding)["random"] == [(10, 44)]
    assert hit >= 95
    for symbols, n, least in ((alphabet[:52], 40, 95), (alphabet, 20, 95), (alphabet, 18, 95), (alphabet, 16, 95)):
        made = ["".join(r.choice(symbols) for _ in range(n)) for _ in range(100)]
        assert sum(secret_scan.find(f"a {t} b", encoding)["random"] == [(2, 2 + n)] for t in made) >= least
    for t in ("getElementsByClassName", "x86_64-unknown-linux-gnu", "src/main/java/org/example", "2024-03-01/2024-04-01",
              "HTTPConnectionPoolManager2Factory", "number_of_documents_per_partition_2024",
              "123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "1234567890123456789012345",
              "electroencephalographically"):
        assert not secret_scan.find(t, encoding)["random"], t


def test_random_spans_are_every_run_tokenised():
    """Against a plain version: every run of secret characters, split and tokenised for itself."""
    encoding = secret_scan.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    r = random.Random(8)
    for _ in range(150):
        t = "".join(r.choice("abcXYZ019+/_=- .,é") for _ in range(r.randint(0, 120)))
        found = secret_scan.find(t, encoding)
        base = [s for k in secret_scan.KINDS[:3] for s in found[k]]
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t):
            if any(s < m.end() and m.start() < e for s, e in base) or not re.search("[A-Za-z]", m[0]):
                continue
            if re.fullmatch("[0-9A-Fa-f]+", m[0]) and len(m[0]) in secret_scan.DIGEST_LENGTHS:
                continue
            if len(m[0]) / len(encoding.encode_ordinary(m[0])) < 1.9:
                want.append(m.span())
        assert found["random"] == want


def test_secret_scan_awkward(spark):
    rows = awkward() + [(20, "password: hunter2hunter2", "en", "a", 1)]
    got = secret_scan.scan(table(spark, rows, True), P.path("byte_bpe_50k.tiktoken")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    empty = hashlib.sha256(b"").hexdigest()
    assert by[1].base_sha256 == by[2].base_sha256 == empty and by[1].spans == ""
    assert by[20].n_assign == 1 and by[20].spans == "assign:0:24"
    assert secret_scan.scan(table(spark, []), P.path("byte_bpe_50k.tiktoken")).count() == 0


def labelled_texts():
    r = random.Random(6)
    out = []
    for i in range(240):
        card = [4] + [r.randint(0, 9) for _ in range(14)]
        card.append((10 - sum(d * 2 - 9 * (d * 2 > 9) if k % 2 == 0 else d for k, d in enumerate(card)) % 10) % 10)
        value = (f"{words(r, 1)}.{i % 90 + 10}@mail{i % 9}.example.com",
                 f"{r.randint(1, 254)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)}",
                 "".join(map(str, card)), f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}")[i % 4]
        out.append(f"{words(r, 30)} {value} {words(r, 30)}")
    return out


def test_gradient_is_right():
    p = {k: v.astype(np.float64) for k, v in tagger.new(5, 4).items()}
    r = np.random.default_rng(1)
    x, y = r.integers(0, tagger.SYMBOLS, (3, 7)), r.integers(0, 5, (3, 7))
    _, g = tagger.loss_and_gradient(x, y, p)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        q, step = p[k][at], 1e-5
        p[k][at] = q + step
        up, _ = tagger.loss_and_gradient(x, y, p)
        p[k][at] = q - step
        down, _ = tagger.loss_and_gradient(x, y, p)
        p[k][at] = q
        assert abs((up - down) / 2 / step - g[k][at]) < 1e-6


def test_tagger_adds_rewritten_values_and_keeps_base(spark):
    texts = labelled_texts()
    weights = personal_data.fit(texts[:200])
    held = personal_data.labelled(texts[200:], windows=200, seed=9)
    right = wrong = missed = 0
    for (t, own), (base, added) in zip(held, personal_data.find([t for t, _ in held], weights)):
        assert base == plain_personal(t)
        got = {(k, s, e) for k in added for s, e in base[k] + added[k]}
        right, wrong, missed = right + len(got & set(own)), wrong + len(got - set(own)), missed + len(set(own) - got)
    assert right / (right + missed) > 0.75 and right / (right + wrong) > 0.9
    # a span over the edge of two windows is one span, wherever it lies
    value = "river.12 (at) mail3.example.com"
    whole = [personal_data.find(["cloud " * k + value + " stone" * 40], weights)[0][1]["email"] for k in range(5, 25)]
    assert sum(len(w) <= 1 for w in whole) == 20
    rows = awkward() + [(20, texts[0], "en", "a", 1)]
    got = {r.doc_id: r for r in personal_data.scan(table(spark, rows, True), weights).collect()}
    assert got[1].spans == "" and got[20].n_email == 1 and got[5].n_card == 0
    assert personal_data.scan(table(spark, []), None).count() == 0
    assert personal_data.fit([]) is None


def lines_of(lang, r, n):
    stock = {"en": "the and thing ing over with that from house water", "de": "der und nicht ung schaft keit haus wasser über für",
             "fr": "le et pas tion ment eau maison être où déjà"}[lang]
    return words(r, n, stock)


def test_language_held_out_accuracy_and_edges(spark):
    r = random.Random(7)
    rows = [(i, lines_of(("en", "de", "fr")[i % 3], r, r.randint(3, 80)), ("en", "de", "fr")[i % 3], "s", 0) for i in range(400)]
    docs = table(spark, rows, True)
    sample = language.sample(docs, 60)
    taught = {t for _, t in sample}
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 and t in taught for i, t, *_ in rows)
    model = language.fit(sample)
    asked = docs.unionByName(table(spark, awkward(), True)).withColumn("held_out", language.held_out())
    got = language.identify(asked, model).collect()
    assert len(got) == 400 + len(awkward())
    mine = [x for x in got if x.source == "s"]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in mine)
    assert np.mean([x.lang_pred == x.lang for x in mine if x.held_out]) > 0.97
    assert all(0 <= x.score <= 1 for x in got)
    no_letter = [x for x in got if x.text is None or not any(c.isalpha() for c in x.text)]
    assert no_letter and all(x.lang_pred == "und" and x.score == 0 for x in no_letter)
    nothing = language.fit(language.sample(table(spark, [(1, "a b", None, "s", 1)])))
    assert nothing is None and language.identify(docs, nothing).where("lang_pred <> 'und'").count() == 0
    assert language.identify(table(spark, []), model).count() == 0


def test_presence_kernel_is_exact():
    texts = ["Abba cab!", "cab abba", "zz", ""]
    letters = language.letter_codes(["abcz"])
    grams = np.arange(language.GRAMS)
    seen, norms = language.presence(texts, letters, grams)

    def plain(t):
        t = re.sub("[^a-z]+", " ", t.lower())
        return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    for i, a in enumerate(texts):
        assert round(norms[i] ** 2) == len(plain(a))
        for j, b in enumerate(texts):
            assert seen[i] @ seen[j] == len(plain(a) & plain(b))


def test_patience_alignment():
    a, b = "a b c d e f".split(), "a x c d y f".split()
    pairs = licenses.align(a, b)
    assert [a[i] for i, _ in pairs] == ["a", "c", "d", "f"]
    r = random.Random(8)
    for _ in range(300):
        a, b = [r.randint(0, 6) for _ in range(r.randint(0, 15))], [r.randint(0, 6) for _ in range(r.randint(0, 15))]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert [i for i, _ in licenses.align(list("abcdef"), list("abcdef"))] == list(range(6))


def test_licenses_are_found_wherever_they_stand(spark):
    templates = licenses.Templates(licenses.TEMPLATES, licenses.LEAST)
    r = random.Random(9)
    for name, text in licenses.TEMPLATES.items():
        for before in (0, 7, 53):
            t = words(r, before) + ".\n" + text + "\n" + words(r, 40)
            found = templates.find(t)
            assert [f[0] for f in found] == [name] and found[0][3] == 1.0, name
            s, e = found[0][1:3]
            assert t[s:e] == text.rstrip(".").strip('"') or text.startswith(t[s:e])
    line = licenses.TEMPLATES["mit-line"]
    assert len(templates.find(f"{line}\n{line}\nand {line}")) == 3
    edited = licenses.TEMPLATES["mit"].replace("free of charge", "at no cost").replace("\n", " ")
    assert templates.find(edited)[0][0] == "mit" and 0.8 < templates.find(edited)[0][3] < 1
    assert templates.find("licensed software of the version under a general public work") == []
    got = {x.doc_id: x for x in licenses.scan(table(spark, awkward() + [(20, line, "en", "a", 1)], True)).collect()}
    assert got[1].n_licenses == 0 and got[1].license is None and got[20].license == "mit-line"
    assert licenses.scan(table(spark, [])).count() == 0
