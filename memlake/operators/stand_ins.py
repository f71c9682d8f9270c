"""Rule-based stand-ins for the three model stages, for data that has no model answers.

The rules follow from what a message is made of, not from examples: a line of a program's output
starts with a log level; a courtesy has no word but courtesies; a modal verb asks for an action, a
verb of choosing tells a decision, a word for a stretch of planned work belongs to a project note, and
a word for a place in a document is a reference. What has none of these is an observation.
"""

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import kernels
from memlake.functions.text import has_words, spaced, strip, words
from memlake.operators import vector_blocks as vb
from memlake.sources.scratch import cut

# Log levels that start a line of program output.
LOG_LEVELS = ("trace", "debug", "info", "notice", "warn", "warning", "error", "severe", "fatal", "critical")
LOG_LINE = r"(?i)^[^\p{L}]*(" + "|".join(LOG_LEVELS) + r")\s*[\]):|=-]"
# Words of greeting, thanks, assent and farewell.
COURTESIES = (
    "hello", "hi", "hey", "welcome", "greetings", "good", "morning", "day", "evening", "night",
    "thanks", "thank", "you", "please", "cheers", "sorry", "yes", "no", "ok", "okay", "sure", "fine", "nice",
    "great", "bye", "goodbye", "farewell",
)
# Cues of entry types in order of precedence; several words are a run.
TYPE_CUES = (
    ("action_item", ("must", "should", "ought to", "have to", "has to", "todo", "remember to")),
    ("decision", ("choose", "chosen", "decide", "decided", "select", "selected", "prefer", "opt for", "settle on")),
    ("project_note", ("project", "roadmap", "phase", "iteration", "deadline", "release plan")),
    ("reference", ("chapter", "section", "page", "manual", "appendix", "footnote", "http", "https", "see also")),
)
MIN_WORDS = 4


def rule_label(text) -> Column:
    """system_noise, chit_chat, too_short or store, in this order of precedence."""
    clean = strip(text)
    courtesies = F.array(*[F.lit(w) for w in COURTESIES])
    said = words(F.substring(clean, 1, 400))
    # a text longer than all courtesies together is none; its words are not listed
    polite = (F.length(clean) < 400) & (F.size(said) > 0) & (F.size(F.array_except(said, courtesies)) == 0)
    return (
        F.when(clean.rlike(LOG_LINE), "system_noise")
        .when(polite, "chit_chat")
        .when(~has_words(text, MIN_WORDS), "too_short")
        .otherwise("store")
    )


def rule_gate(texts: DataFrame) -> DataFrame:
    """(request_id, text) -> a gate verdict in the shape of `gate_results`."""
    label = rule_label("text")
    return texts.select(
        "request_id", F.lit(1).alias("attempt"), F.lit(False).alias("fatal"),
        label.alias("label"), F.when(label == "store", 0.75).otherwise(0.9).alias("confidence"),
        F.lit("rule").alias("reason"), (label == "store").alias("should_store"),
    )


_KINDS = ("topics", "people", "projects")


def rule_metadata(texts: DataFrame, gazetteer: DataFrame, *, dictionary_bytes: int = vb.BROADCAST_BYTES) -> DataFrame:
    """(request_id, text) + (term, kind: topics | people | projects) -> metadata per request.

    Terms match as runs of whole words, without regard to case. All terms and cues are one
    Aho-Corasick automaton, and one pass over a text finds them all where the text lies. A
    dictionary whose counted size exceeds `dictionary_bytes` is cut into parts that each fit, with
    one pass for each, and a request's finds are put together by an aggregate.
    """
    known = gazetteer.where(F.col("kind").isin(*_KINDS)).select(
        "kind", "term", F.array_join(words("term"), " ").alias("run")).where("run <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("term") + F.octet_length("run") + 64)).first()[0] or 0
    parts = max(1, -(-size // dictionary_bytes))
    if parts > 1:
        known = cut(known)
    none = F.array().cast("array<string>")
    rows = texts.select("request_id", "text")
    if parts == 1:
        found = rows.withColumn("found", _found(rows, known)(spaced(F.coalesce("text", F.lit("")))))
    else:
        keyed = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        each = None
        for no in range(parts):
            part = known.where(F.pmod(F.xxhash64("run"), F.lit(parts)) == no)
            hits = keyed.select("row", _found(rows, part)(spaced(F.coalesce("text", F.lit("")))).alias("part"))
            each = hits if each is None else each.unionByName(hits)
        together = each.groupBy("row").agg(F.struct(
            F.min("part.cue").alias("cue"),
            *[F.array_sort(F.flatten(F.collect_list(F.col("part")[kind]))).alias(kind) for kind in _KINDS],
        ).alias("found"))
        found = keyed.join(together, "row").drop("row")
    cues = F.array(*[F.lit(name) for name, _ in TYPE_CUES], F.lit("observation"))
    return found.withColumn("entry_type", cues[F.col("found.cue")]).select(
        "request_id", F.lit(1).alias("attempt"), "entry_type", *[F.col(f"found.{kind}").alias(kind) for kind in _KINDS],
        F.when(F.col("entry_type") == "action_item", F.array(strip("text"))).otherwise(none).alias("action_items"),
    )


def _found(rows: DataFrame, known: DataFrame):
    """Function from spaced text to the first cue's rank and the sorted terms of each kind."""
    table = vb.fetch(known)  # of a size that the caller has bounded
    terms = [(k, t, r) for k, t, r in zip(*(table.column(c).to_pylist() for c in ("kind", "term", "run")))]
    cues = [(n, run) for n, (_, runs) in enumerate(TYPE_CUES) for run in runs]
    shared = vb.share(rows, {"terms": terms, "cues": cues})
    kind = "struct<cue:int," + ",".join(f"{k}:array<string>" for k in _KINDS) + ">"
    return F.arrow_udf(kernels.dictionary_finds(shared, _KINDS, len(TYPE_CUES)), kind)
