"""Personal data: fixed patterns, and identifiers found from the company they keep.

Base entities come from four patterns (built-in functions only; positions are
cumulated from the pieces between matches). They and keys of well-known make
seed a bootstrap over the pattern-instance graph. An instance is a token that
could be an identifier: one of a kind's near shapes, or any long mix of letters
and digits. A pattern is what surrounds it: one to three words before with the
punctuation or key in front of it, the word after, or both sides together. In
each round a pattern's confidence is the trusted share of all places of the
corpus where it stands, an instance's trust that of its best pattern with enough
different trusted instances; instances accepted in one round vouch for further
patterns in the next. What is trusted at the end is reported beside the base
entities, as its kind or as ``secret``. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.llm._state import keep

KINDS = ("email", "ip", "card", "phone")
#: Found by context only; listed after the others.
SECRET = "secret"
#: The base patterns. Possessive repeats and look-behinds only save
#: time: they keep the leftmost matches of the plain patterns. That for cards takes
#: only those of 13 to 19 digits, as matches are whole chains of digits.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot hold the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Shapes of tokens that may be an instance of a kind although the base pattern fails.
SHAPES = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:@|\[at\]|\(at\))[a-z0-9.-]++",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{1,4}(?![0-9a-f:])|(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9x*-])[0-9x*]{4}(?:-[0-9x*]{4}){3}(?![0-9x*-])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "phone": r"(?<![0-9.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[.-][0-9]{3,4}[.-][0-9]{3,4}(?![0-9.-])|(?<![0-9])00[0-9]{9,13}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{12,}+={0,2}(?![A-Za-z0-9_+/=-])",
}
SHAPE_NEEDS = {
    "email": r"[@\[(](?:(?<=@)|(?i:at[\])]))",
    "ip": r"[:\[](?:(?<=:)[0-9a-fA-F]{0,4}:|(?<=\[)\.\])",
    "card": r"[0-9x*]{4}(?:-[0-9x*]{4}-|(?<=[0-9]{4})[0-9]{9})",
    "phone": r"[0-9]{3}(?:[0-9]?[.-][0-9]{3}|(?<=00[0-9])[0-9]{8})",
    "secret": r"[0-9](?:(?<=[A-Za-z_+/-][0-9])|(?=[A-Za-z_+/-]))",
}
#: Seeds among the tokens of kind secret: digests and keys in formats that their issuers have published.
SECRET_SEEDS = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|akia[0-9a-z]{16}|gh[opsru]_[0-9a-z]{36}|xox[abprs]-[0-9a-z-]{20,})$"
#: Rounds of scoring; the confidence from which on a pattern discovers, and its number of different trusted instances.
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.5, 5
#: Characters beside an entity within which its words must stand.
CONTEXT = 96
#: A key with its sign (as in ``token=``) and opening punctuation before a token; punctuation after it.
LEAD, TRAIL = r"(?:[\p{L}_.-]*[\"']?[=:])?[\"'(\[<{]*", r"[^\p{L}\p{N}\s]*"
#: Words beside patterns up to which lists of them filter the corpus' places before these
#: are counted (else all are); rows up to which tables of patterns or texts are broadcast.
LISTED_WORDS, BROADCAST_ROWS = 5_000, 50_000
#: Matches whose places are cumulated at a time.
STRIDE = 256

_SPANS = "array<struct<start:int,stop:int>>"


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        twice = F.pmod(n - i, F.lit(2)) == 1
        v = F.when(twice & (d > 4), d * 2 - 9).when(twice, d * 2).otherwise(d)
        return total + v

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    return F.length(digits).between(9, 15)


def _sums(steps: Column) -> Column:
    """Running totals of an array<int>; strides are summed first, so that no long array grows step by step."""
    empty = F.array().cast("array<int>")

    def add(s: Column, x: Column) -> Column:
        return F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))

    def running(values: Column, first: Column) -> Column:
        return F.aggregate(values, F.struct(first.alias("at"), empty.alias("out")), add, lambda s: s["out"])

    strides = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STRIDE).cast("int"))
    totals = F.transform(strides, lambda c: F.aggregate(F.slice(steps, c * STRIDE + 1, F.lit(STRIDE)), F.lit(0), lambda a, x: a + x))
    each = F.arrays_zip(strides.alias("c"), running(totals, F.lit(0)).alias("end"), totals.alias("own"))
    return F.when(F.size(steps) > 0, F.flatten(F.transform(each, lambda x: running(F.slice(steps, x["c"] * STRIDE + 1, F.lit(STRIDE)), x["end"] - x["own"])))).otherwise(empty)


def _matched(rows: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Append for each name an array<struct<start,stop,match,before,after>> of its pattern's matches in column text.

    Places are in code points, stop exclusive; before and after are the characters
    beside the match, with a space for the text's edge. Matches and the gaps between
    them alternate, so lengths give the places.
    """
    own = rows.columns
    none = F.array().cast("array<string>")
    found = {k: F.when(F.col("text").rlike(needs), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"{k} found") for k, (p, needs) in patterns.items()}
    rows = rows.select(*own, F.length("text").alias("n"), *found.values())
    gaps = {k: F.when(F.size(f"{k} found") > 0, F.split("text", p, -1)).otherwise(none).alias(f"{k} gaps") for k, (p, _) in patterns.items()}
    rows = rows.select("*", *gaps.values())

    def zipped(k: str) -> Column:
        f, g = F.col(f"{k} found"), F.col(f"{k} gaps")
        edge = F.array(F.lit(""))
        n = F.size(f)
        return F.arrays_zip(F.slice(F.concat(edge, g), 1, n).alias("gap0"), F.slice(F.concat(edge, f), 1, n).alias("match0"), F.slice(g, 1, n).alias("gap"), F.slice(g, 2, n).alias("next"), f.alias("match"))

    rows = rows.select(*own, "n", *[zipped(k).alias(f"{k} each") for k in patterns], *[F.transform(F.arrays_zip(F.slice(f"{k} gaps", 1, F.size(f"{k} found")).alias("gap"), F.col(f"{k} found").alias("match")), lambda x: F.length(x["gap"]) + F.length(x["match"])).alias(f"{k} steps") for k in patterns])
    rows = rows.select(*own, "n", *[f"{k} each" for k in patterns], *[_sums(F.col(f"{k} steps")).alias(f"{k} stops") for k in patterns])

    def placed(x: Column, stop: Column) -> Column:
        start = stop - F.length(x["match"])
        before = F.right(F.concat(F.right(x["gap0"], F.lit(CONTEXT)), x["match0"], x["gap"]), F.lit(CONTEXT))
        after = F.left(x["next"], F.lit(CONTEXT))
        edged = F.concat(F.when(F.length(before) == start, F.lit(" ")).otherwise(F.lit("")), before)
        return F.struct(start.alias("start"), stop.alias("stop"), x["match"].alias("match"), edged.alias("before"), F.concat(after, F.when(stop + F.length(after) == F.col("n"), F.lit(" ")).otherwise(F.lit(""))).alias("after"))

    return rows.select(*own, *[F.zip_with(f"{k} each", f"{k} stops", placed).alias(k) for k in patterns])


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def _keys(l3: Column, l2: Column, l1: Column, lead: Column, trail: Column, r1: Column) -> dict[str, Column]:
    """The patterns around one place, null where a part is missing."""
    lead, trail = F.concat(F.lit("<"), lead), F.concat(trail, F.lit(">"))
    space = F.lit(" ")
    return {
        "left1": F.concat(l1, space, lead),
        "left2": F.concat(l2, space, l1, space, lead),
        "left3": F.concat(l3, space, l2, space, l1, space, lead),
        "right": F.concat(trail, space, r1),
        "both": F.concat(l1, space, lead, F.lit("_"), trail, space, r1),
        "key": F.when(lead.rlike("[=:]"), F.concat(F.lit("_ "), lead)),
    }


def _around(m: Column) -> Column:
    """array<string>: the patterns around a match."""
    before, after = F.lower(m["before"]), F.lower(m["after"])
    words = [F.nullif(F.regexp_extract(before, r"\s(\S+)" + r"\s+\S+" * k + r"\s+\S*$", 1), F.lit("")) for k in range(3)]
    lead = F.regexp_extract(before, r"(?<=\s)(\S*)$", 1)
    lead = F.when(before.rlike(rf"\s{LEAD}$"), lead)
    trail = F.when(after.rlike(rf"^{TRAIL}\s"), F.regexp_extract(after, r"^(\S*)", 1))
    right = F.nullif(F.regexp_extract(after, r"^\S*\s+(\S+)\s", 1), F.lit(""))
    keys = _keys(words[2], words[1], words[0], lead, trail, right)
    # a token of several words has no place of its own among the words, which are counted one by one
    keys["both"] = F.when(~m["match"].contains(" "), keys["both"])
    return F.filter(F.array(*keys.values()), lambda k: k.isNotNull())


def scan(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, h1, h2 (hash of the text), a span array per kind, and ``seen``: base entities and candidates with their patterns."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{doc}`").alias("doc"), F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2"), value.alias("text"))
    rows = _matched(rows, {k: (PATTERNS[k], NEEDS[k]) for k in KINDS} | {f"maybe_{k}": (SHAPES[k], SHAPE_NEEDS[k]) for k in SHAPES})
    # matches that fail their check are dropped and not tried again
    rows = rows.select("doc", "h1", "h2", *[F.filter(k, lambda m: _valid(k, m["match"])).alias(k) for k in KINDS], *[f"maybe_{k}" for k in SHAPES])
    rows = rows.select("*", F.concat(*[F.transform(k, lambda m: F.struct(m["start"], m["stop"])) for k in KINDS]).alias("known"))

    def named(k: str, base: bool) -> Column:
        fresh = F.col(k) if base else F.filter(f"maybe_{k}", lambda m: ~F.exists("known", lambda b: _overlap(m, b)))
        return F.transform(fresh, lambda m: F.struct(F.lit(k).alias("kind"), F.lit(base).alias("base"), m.alias("m")))

    def one(x: Column) -> Column:
        m = x["m"]
        token = F.lower(m["match"])
        seed = x["base"] | ((x["kind"] == SECRET) & token.rlike(SECRET_SEEDS))
        return F.struct(x["kind"].alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), token.alias("token"), _around(m).alias("patterns"), seed.alias("seed"), x["base"].alias("base"))

    every = F.transform(F.concat(*[named(k, True) for k in KINDS], *[named(k, False) for k in SHAPES]), one)
    spans = [F.transform(k, lambda m: F.struct(m["start"], m["stop"])).alias(k) for k in KINDS]
    return rows.select("doc", "h1", "h2", *spans, every.alias("seen"))


def _sized(rows: DataFrame) -> DataFrame:
    """A checkpointed table, broadcast if its counted size allows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def discover(df: DataFrame, scanned: DataFrame, text: str = "text", rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(h1, h2, kind, start, stop): candidates that confident patterns vouch for, wherever they stand.

    Confidence is the trusted share of all places of a pattern; only patterns with
    ``support`` different trusted instances count (copies of one text must not make
    a pattern). Seeds are trusted throughout, others as far as their best pattern.
    """
    spots = scanned.select("h1", "h2", F.explode("seen").alias("s")).select("h1", "h2", "s.*")
    edges = spots.select("kind", "token", "seed", F.explode("patterns").alias("pattern"))
    edges = keep(edges.groupBy("kind", "pattern", "token").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    # a pattern with fewer instances in all never gets enough that are trusted; one kind needs a seed
    rich = edges.groupBy("kind", "pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("spots")).where(F.col("instances") >= support)
    rich = keep(rich.select("kind", "pattern", "spots"))
    patterns = keep(rich.join(_places(df, text, rich.select("pattern").distinct()), "pattern", "left").select("kind", "pattern", F.greatest("spots", F.coalesce("count", F.lit(0))).alias("count")))
    graph = keep(edges.join(_sized(patterns), ["kind", "pattern"]))
    trust = graph.where("seed").select("kind", "token").distinct().withColumn("trust", F.lit(1.0))
    for _ in range(rounds):
        sure = graph.join(trust, ["kind", "token"], "left").withColumn("sure", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("trust", F.lit(0.0))))
        scored = sure.groupBy("kind", "pattern").agg(F.sum(F.col("n") * F.col("sure")).alias("trusted"), F.first("count").alias("count"), F.count(F.when(F.col("sure") >= confidence, 1)).alias("entities"))
        scored = keep(scored.where(F.col("entities") >= support).select("kind", "pattern", (F.col("trusted") / F.col("count")).alias("score")))
        trust = keep(graph.join(_sized(scored), ["kind", "pattern"]).groupBy("kind", "token").agg(F.max("score").alias("trust")))
    found = keep(trust.where(F.col("trust") >= confidence).select("kind", "token"))
    return spots.where("NOT base").join(_sized(found), ["kind", "token"], "left_semi").select("h1", "h2", "kind", "start", "stop").distinct()


def _places(df: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, count): at how many words of all texts (lower-cased, between white space) each of the patterns stands."""
    patterns = keep(patterns)
    kind = F.when(F.col("pattern").startswith("_ "), "key").when(F.col("pattern").rlike(r"^\S*> "), "right").otherwise("left")
    # the word beside the token: the last before it, or the one after it
    beside = F.when(kind == "right", F.regexp_extract("pattern", r" (\S+)$", 1)).when(kind == "left", F.regexp_extract("pattern", r"(\S+) <[^<]*$", 1))
    beside = F.when(F.col("pattern").rlike(r"_\S*> \S+$") & (kind == "left"), F.regexp_extract("pattern", r"(\S+) <[^<]*_\S*> \S+$", 1)).otherwise(beside)
    listed = keep(patterns.select(kind.alias("kind"), beside.alias("word")).distinct())
    n = listed.count()
    if not n:
        return patterns.withColumn("count", F.lit(0).cast("long"))
    words = F.split(F.lower(F.col(f"`{text}`").cast("string")), r"\s+")
    edge = F.array(F.lit("").cast("string"))
    rows = df.select(words.alias("w")).where(F.col("w").isNotNull())
    rows = rows.select(F.concat(edge, edge, edge, "w").alias("a"), F.concat(edge, edge, "w").alias("b"), F.concat(edge, "w").alias("c"), "w", F.concat(F.slice("w", 2, F.size("w")), edge).alias("d"))
    size = F.size("w")
    rows = rows.select(F.inline(F.arrays_zip(F.slice("a", 1, size).alias("l3"), F.slice("b", 1, size).alias("l2"), F.slice("c", 1, size).alias("l1"), F.col("w").alias("own"), F.col("d").alias("r1"))))
    if n <= LISTED_WORDS:
        by: dict[str, list[str]] = {}
        for r in listed.collect():
            by.setdefault(r["kind"], []).append(r["word"])
        tests = [F.col(c).isin(by[k]) for k, c in (("left", "l1"), ("right", "r1")) if k in by]
        if "key" in by:
            tests.append(F.col("own").rlike("[=:]"))
        wanted = tests[0]
        for t in tests[1:]:
            wanted = wanted | t
        rows = rows.where(wanted)
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("l3", "l2", "l1")]
    lead, trail = F.regexp_extract("own", rf"^({LEAD})", 1), F.regexp_extract("own", rf"({TRAIL})$", 1)
    rows = rows.select(*[p.alias(c) for p, c in zip(parts, ("l3", "l2", "l1"), strict=True)], lead.alias("lead"), trail.alias("trail"), F.nullif("r1", F.lit("")).alias("r1"))
    keys = _keys(*[F.col(c) for c in ("l3", "l2", "l1", "lead", "trail", "r1")])
    each = rows.select(F.explode(F.array(*keys.values())).alias("pattern")).where(F.col("pattern").isNotNull())
    return each.join(_sized(patterns), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("count"))


def _listed(kind: str, spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"))))
    return F.transform(ordered, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["stop"].cast("string")))


def find(df: DataFrame, doc: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """doc, a count of base entities per kind, base_sha256, spans and n_discovered of every row.

    Spans are kind:start:stop, by kind as in ``KINDS``, then ``SECRET``, and then by
    start; n_discovered counts those beyond the base. Null and empty texts have
    none; very long texts are read whole; repeated rows stay and get the same; an
    id of null stays null; other columns of any name are left out. Discoveries
    overlap no base entity and change no base result.
    """
    scanned = keep(scan(df, doc, text))
    new = discover(df, scanned, text, **options)
    more = keep(new.groupBy("h1", "h2").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("new")))
    joined = scanned.drop("seen").join(_sized(more), ["h1", "h2"], "left").withColumn("new", F.coalesce("new", F.array().cast("array<struct<kind:string,start:int,stop:int>>")))

    def own(kind: str) -> Column:
        return F.transform(F.filter("new", lambda m: m["kind"] == kind), lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop")))

    base = F.array_join(F.concat(*[_listed(k, F.col(k)) for k in KINDS]), ",")
    spans = F.array_join(F.concat(*[_listed(k, F.concat(F.col(k), own(k))) for k in KINDS], _listed(SECRET, own(SECRET))), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return joined.select(F.col("doc").alias(doc), *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), F.size("new").cast("long").alias("n_discovered"))
