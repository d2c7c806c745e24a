"""Secret scans with corpus-wide ownership frequency; SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from raresight.llm.common import cut

#: The base kinds, in their order, as (pattern, group measured, least length).
BASE = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}
#: Candidates beside them: runs long enough for a key that mix digits and both cases.
BARE, BARE_LENGTH = "[A-Za-z0-9+/_=-]{20,}", 20
#: A value in more repositories, or of more owners, than this is an example that people copy.
MAX_REPOSITORIES, MAX_OWNERS = 3, 2
SALTS = 16
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters.

    The gaps that splitting leaves and the matches alternate, so their lengths add
    up to code point positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), part, lambda x, p: F.struct(x["g"].alias("g"), x["m"].alias("m"), p.alias("p")))
    nothing = F.lit(None).cast(SPAN)
    zero = F.struct(F.lit(0).alias("at"), F.coalesce(nothing, F.array().cast(SPAN)).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["p"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["p"]) >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pieces, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_place(spans: Column) -> Column:
    """Spans by start, then kind in the order listed."""
    kinds = F.array(*[F.lit(k) for k in [*BASE, "live"]])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source",
         max_repositories: int = MAX_REPOSITORIES, max_owners: int = MAX_OWNERS) -> DataFrame:
    """A row per document: (key, base, spans, n_live, n_example).

    ``base`` are the spans of the base kinds, ``spans`` those and bare key-like runs
    outside them whose value looks live. Values are hashed and counted over the
    whole corpus by distinct repositories and owners: one found in at most
    ``max_repositories`` and of at most ``max_owners`` is the owner's own (live),
    others are copied examples. Null texts are empty, null repositories and owners
    count as one each, repeated rows are scanned each and count once.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # null bytes of kinds without a match cost nothing: each kind is searched only where its pattern occurs
    base = by_place(F.concat(*[matches(F.col("__t"), kind, *rule) for kind, rule in BASE.items()]))
    bare = F.filter(matches(F.col("__t"), "live", BARE, 0, BARE_LENGTH), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    found = docs.select(F.col(key).alias("key"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), body.alias("__t"))
    found = found.withColumns({"base": base, "bare": bare})
    outside = F.filter("bare", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    hashed = lambda s: F.xxhash64(s["value"])
    spans = F.transform(F.concat("base", outside), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), hashed(s).alias("value")))
    rows = cut(found.select("key", "repository", "owner", F.monotonically_increasing_id().alias("row"), spans.alias("spans")))
    each = rows.where(F.size("spans") > 0).select("row", "repository", "owner", F.explode("spans").alias("s"))
    places = each.select(F.col("s.value").alias("hash"), "repository", "owner").distinct()
    per_owner = places.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    repositories = places.select("hash", "repository").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    owned = per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners")).join(repositories, "hash")
    live = owned.where((F.col("repositories") <= max_repositories) & (F.col("owners") <= max_owners)).select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("live"))
    salted = each.withColumns({"hash": F.col("s.value"), "salt": F.pmod("row", F.lit(SALTS)).cast("int")})
    judged = salted.join(live, ["hash", "salt"], "left").select("row", "s", F.coalesce("live", F.lit(False)).alias("live"))
    lists = judged.groupBy("row").agg(F.collect_list(F.struct("s.kind", "s.start", "s.end", "live")).alias("all"))
    out = rows.select("key", "row").join(lists, "row", "left")
    kinds = F.array(*[F.lit(k) for k in [*BASE, "live"]])
    ordered = F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"), s["live"].alias("live"))))
    none = F.array().cast("array<struct<start:int,k:bigint,end:int,kind:string,live:boolean>>")
    out = out.select("key", F.coalesce(ordered, none).alias("all"))
    return out.select(
        F.col("key").alias(key),
        F.filter("all", lambda s: s["kind"] != "live").alias("base"),
        F.filter("all", lambda s: (s["kind"] != "live") | s["live"]).alias("spans"),
        F.size(F.filter("all", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )
