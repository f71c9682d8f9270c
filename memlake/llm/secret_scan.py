"""Secrets: fixed patterns, and random strings that a tokenizer's vocabulary compresses badly.

Words of a language are long tokens; random strings fall apart into short ones. A run of secret
characters is a finding of kind `random` where its characters per token stay below a limit, after
known digests and identifiers are set aside: digests of the usual lengths, UUIDs, and runs without a
letter, which are numbers, dates and the like. Names made of words are long tokens themselves and
need no rule. Random letters of one case come close to rare words; some of them are missed.

Defined results: null and empty text have no spans; repeated rows are scanned alike; a run of
any length is one candidate, tokenised in pieces so that its cost stays linear.
"""

import base64
import re

from pyspark.sql import DataFrame

from memlake.llm import rows, spans

KINDS = ("assign", "access", "hex", "random")
SECRET_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A candidate has at least this many characters, and fewer than this many per token.
LEAST, PER_TOKEN = 16, 1.9
#: Characters tokenised at a time.
PIECE = 256

# Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512, and the form of a UUID.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
HEX = re.compile(r"[0-9A-Fa-f]+")


def vocabulary(path: str):
    """A tiktoken encoding from a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        "secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Digests of known lengths, UUIDs, and runs without a letter."""
    return bool(UUID.fullmatch(run) or (len(run) in DIGEST_LENGTHS and HEX.fullmatch(run))
                or not any(c.isalpha() for c in run))


def per_token(run: str, encoding) -> float:
    tokens = sum(len(encoding.encode_ordinary(run[i:i + PIECE])) for i in range(0, len(run), PIECE))
    return len(run) / tokens


def find(text: str, encoding, chars=spans.table(SECRET_CHARS)) -> dict[str, list]:
    """All spans of one text by kind; random ones don't overlap the others."""
    code = spans.codes(text)
    found = spans.secrets(text, code)
    base = [s for k in KINDS[:3] for s in found[k]]
    found["random"] = [
        (s, e) for s, e in spans.runs(code, chars, LEAST)
        if not spans.overlaps(base, s, e) and not known(text[s:e])
        and per_token(text[s:e], encoding) < PER_TOKEN]
    return found


def scan(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random per row of docs."""

    def make():
        encoding = vocabulary(vocabulary_path)

        def work(cols):
            found = [find(t, encoding) for t in rows.texts(cols["text"])]
            out = {f"n_{k}": [len(f[k]) for f in found] for k in KINDS}
            return out | {
                "doc_id": cols["doc_id"],
                "base_sha256": [spans.sha256(spans.joined(f, KINDS[:3])) for f in found],
                "spans": [spans.joined(f, KINDS) for f in found]}

        return work

    return rows.map_batches(
        docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long", make)
