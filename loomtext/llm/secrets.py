"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Each text is searched once by three fixed patterns (base kinds) and for long mixed tokens (candidates). Hashes of
all values are counted over the corpus by distinct repository and distinct owner, and both counts decide: a value
that COPIED_OWNERS owners or COPIED_REPOSITORIES repositories hold is a widely copied example; one that stays below
both looks live. Live candidates add spans of kind ``owned``. In ``documents`` every row stands for a repository and
``source`` for its owner.

Nulls: a null text is empty, a null owner counts as one owner of its own. Rows with equal doc_id and text give
equal results. Spans are code points, end exclusive, ordered by start and then by kind as in ``KINDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.storage import aside, only, settle

KINDS = ("assign", "access", "hex", "owned")
#: The patterns of the base kinds. ASSIGN spells both cases out, for engines whose flag i folds beyond ASCII.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: A run shorter than asked never hides a longer one in these, so the least length may stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}"
ASSIGN_LEAST = 8
#: A value held by so many owners, or in so many repositories, or more is a widely copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 20
#: Matches of a text are placed in chunks of so many, so that no list grows match by match.
CHUNK = 64

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _runs_of(letters: str, least: int) -> str:
    """A pattern for whole runs of some letters; a search does not begin again within a run that was too short."""
    return f"(?<!{letters}){letters}{{{least},}}"


def _places(pieces: Column, found: Column) -> Column:
    """Start of each match: what precedes it, pieces and matches in turn. Sums run within chunks, then over chunks."""
    steps = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
    append = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"] + x)).alias("out"))
    none = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(steps, c * CHUNK + 1, F.lit(CHUNK)), none, append))
    before = F.aggregate(chunks, none, lambda s, c: F.struct((s["sum"] + c["sum"]).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")), lambda s: s["out"])
    return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(c["out"], lambda x: x + b)))


def _spans(text: Column, pattern: str, kind: int, may: Column, group: int = 0, least: int = 0) -> Column:
    """Matches of a pattern with their places: the pieces between matches and the matches themselves add up to them.

    may: a cheap test that every text with a match passes.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = lambda m: F.regexp_extract(m, pattern, group) if group else m
    one = lambda m, start: F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), value(m).alias("value"))
    rows = let(F.struct(pieces.alias("p"), found.alias("m")), lambda s: F.zip_with(s["m"], _places(s["p"], s["m"]), one))
    return F.when(may & F.regexp_like(text, F.lit(pattern)), F.filter(rows, lambda r: F.length(r["value"]) >= least)).otherwise(F.array().cast(_SPAN))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, owner, base spans and candidate spans that touch no base span."""
    text = F.coalesce("text", F.lit(""))
    own = only(docs, "doc_id", "text", "source").select("doc_id", F.col("source").alias("owner"), text.alias("text"))
    own = own.withColumn("text_hash", F.xxhash64("text"))
    text, low = F.col("text"), F.lower("text")
    named = low.contains("pass") | low.contains("secret") | low.contains("token") | low.contains("api")
    base = _spans(text, ASSIGN, 0, named, 2, ASSIGN_LEAST), _spans(text, ACCESS, 1, text.contains("AKIA")), _spans(text, _runs_of("[0-9a-f]", 32), 2, F.lit(True))
    own = own.withColumn("base", F.array_sort(F.concat(*base)))
    long = _spans(text, _runs_of("[A-Za-z0-9+/_-]", 24), 3, F.lit(True))
    mixed = lambda c: c["value"].rlike("[0-9]") & c["value"].rlike("[A-Z]") & c["value"].rlike("[a-z]")
    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    own = own.withColumn("candidates", F.filter(long, lambda c: mixed(c) & apart(c)))
    hashed = lambda xs: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    return own.select("doc_id", "text_hash", "owner", hashed(F.col("base")).alias("base"), hashed(F.col("candidates")).alias("candidates"))


def ownership(scanned: DataFrame) -> DataFrame:
    """Per value hash: distinct repositories and owners. Pairs are made distinct first, so a hot value is summed before it moves."""
    values = scanned.select("doc_id", "owner", F.explode(F.array_distinct(F.transform(F.concat("base", "candidates"), lambda s: s["hash"]))).alias("hash"))
    by_repo = values.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("x")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_repo.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def find(docs: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """Per row: doc_id, text_hash, base spans, all spans, and how many values look live or copied."""
    scanned = settle(scan(docs), "secrets-scan")
    live = (F.col("owners") < copied_owners) & (F.col("repositories") < copied_repositories)
    values = scanned.select("doc_id", "text_hash", F.explode(F.concat("base", "candidates")).alias("s")).select("doc_id", "text_hash", "s.*").distinct()
    judged = values.join(ownership(scanned), "hash")
    added = F.collect_list(F.when(live & (F.col("kind") == 3), F.struct("start", "kind", "end", "hash")))
    per = judged.groupBy("doc_id", "text_hash").agg(added.alias("added"), F.sum(live.cast("long")).alias("n_live"), F.sum((~live).cast("long")).alias("n_copied"))
    per = per.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "added", "n_live", "n_copied")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
    joined = scanned.join(per, same, "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int,hash:string>>"))))
    return joined.select("doc_id", "text_hash", "base", spans.alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, all spans."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return find(docs).select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), "n_live", "n_copied")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """The documents with each run of overlapping spans replaced by ``mark``; n_chars follows the new text."""
    docs, restored = aside(docs, "doc_id", "text", "source", "n_chars")
    hit = find(docs).filter(F.size("spans") > 0).select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "spans").dropDuplicates(["of_id", "of_hash"])
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(hit, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("_text_hash") == F.col("of_hash")), "left")

    def step(state, s):
        apart = s["start"] >= state["at"]
        gap = F.when(apart, F.concat(state["out"], F.substring("text", state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), gap.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring("text", s["at"] + 1, F.length("text")))
    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean)
    out = joined.withColumn("text", text)
    n_chars = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return restored(out.withColumn("n_chars", n_chars))
