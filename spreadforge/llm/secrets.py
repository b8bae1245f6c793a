"""Secret scans: fixed patterns plus a randomness test battery.

Base spans come from three patterns.  The battery looks at every other run of
16 or more token characters, and at its parts without ``-_``, without ``+/`` and
without either: the encoding of each is inferred from its characters, then

* a chi-squared test of uniform use of that encoding's alphabet,
* a runs test (changes between the alphabet's lower and upper half) and
* a lag-1 serial-correlation test of the symbol values

give p-values for "drawn at random"; the combined value is three times the
smallest, at most 1.  A token is a secret if it looks random, so the risk is
words and numbers that pass.  That risk is measured on the corpus itself, per
encoding and length class: decoys are the corpus's own long words (numbers, for
tokens of digits) joined and cut to that length, written the way the encoding
would have them and tested in its alphabet.  The number of tokens that are no
secrets is estimated from those with small values, where decoys are and random
tokens hardly ever.  The limit is the lowest value at which the false
discoveries so expected are a share of at most ``FDR`` of the tokens reported.
Ties: tokens of equal value class are reported together or not at all.

JVM functions only, linear in the token.  Tokens and decoys meet in tables of
counts by (encoding, length class, value class) of fixed size; texts are never
shuffled.

Defined results: a null text counts as empty; positions count code points; a
token that overlaps a base span, or lies within a longer reported token, is not
reported; repeated rows get equal results; other columns are ignored."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadforge.llm.tables import materialize, row_id, shuffled

#: fixed patterns: kind, pattern, group whose length counts, least length
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
#: what is tested of a run of token characters
PARTS = (r"[A-Za-z0-9+/]{16,}", r"[A-Za-z0-9_-]{16,}", r"[A-Za-z0-9]{16,}")
#: encodings, narrowest first: name, pattern, alphabet, and how decoys are written in it
ALPHABETS = (
    ("digits", r"^[0-9]+$", "0123456789", "number"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef", "lower"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF", "upper"),
    ("lower", r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", "lower"),
    ("upper", r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "upper"),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", "lower"),
    ("BASE36", r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"),
    ("letters", r"^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "title"),
    ("base62", r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "title"),
    ("base64", r"^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "path"),
    ("base64url", r"^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "slug"),
)
#: decoys of encodings that words cannot be written in are tested as words
WORD_ALPHABET = {"hex": "abcdefghijklmnopqrstuvwxyz", "HEX": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: what decoys are joined from: long words, and numbers too short to be tokens
DECOY = r"[A-Za-z]{12,}|(?<![0-9])[0-9]{4,15}(?![0-9])"
#: words joined into one decoy text; each such text gives a decoy of every encoding and length class
JOINED = 32
#: length classes are quarter octaves up to this one (256 characters); longer tokens meet its decoys
LONGEST = 32
FDR = 0.05
STEPS = 200
#: value classes below this one (values below 0.05) are taken to hold hardly any random tokens
SMALL = 10


def spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """``start, end, match`` (code points) of the leftmost non-overlapping
    matches whose ``group`` has at least ``least`` characters.  The text between
    matches gives their positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    # zipped once: the last gap has no match
    rows = F.filter(F.arrays_zip(between.alias("gap"), found.alias("match"), value.alias("value")), lambda x: x["match"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,match:string,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            begin.alias("start"), end.alias("end"), x["match"].alias("match"), x["value"].alias("value")))).alias("out"))

    every = F.aggregate(rows, start, step, lambda acc: acc["out"])
    every = F.when(F.size(found) == 0, empty).otherwise(every)
    return F.transform(F.filter(every, lambda s: F.length(s["value"]) >= least),
                       lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    p = F.exp(-a * a / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, p).otherwise(F.lit(1.0) - p)


def _with_battery(tokens: DataFrame) -> DataFrame:
    """Combined p-value ``p`` that the symbols of ``token`` are drawn uniformly
    and independently from ``alphabet``.  One pass over the token for the runs
    and the correlation, one for each symbol's count."""
    token, k = F.col("token"), F.length("alphabet").cast("double")
    n = F.length(token).cast("double")
    letters = F.filter(F.split("alphabet", ""), lambda c: c != "")
    squares = F.aggregate(letters, F.lit(0.0), lambda a, c: a + F.pow((F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0)))
    half, mid = F.ceil(k / 2).cast("double"), (k - 1) / 2
    start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("changes"), F.lit(0.0).alias("lag"))

    def step(acc, c):
        v, last = (F.instr(F.col("alphabet"), c) - 1).cast("double"), acc["last"]
        change = F.when((last >= 0) & ((last < half) != (v < half)), 1.0).otherwise(0.0)
        return F.struct(v.alias("last"), (acc["changes"] + change).alias("changes"),
                        (acc["lag"] + F.when(last >= 0, (v - mid) * (last - mid)).otherwise(0.0)).alias("lag"))

    walk = F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), start, step)
    t = tokens.withColumns({"__k": k, "__n": n, "__squares": squares, "__walk": walk})
    k, n, df = F.col("__k"), F.col("__n"), F.col("__k") - 1
    chi = k / n * F.col("__squares") - n
    # Wilson-Hilferty: the cube root of chi-squared / df is nearly normal
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df))
    low = F.ceil(k / 2) / k                                       # share of the alphabet's lower half
    q = 2 * low * (1 - low)
    z_runs = (F.col("__walk.changes") - (n - 1) * q) / F.sqrt((n - 1) * q * (1 - q))
    z_lag = F.col("__walk.lag") / ((k * k - 1) / 12) / F.sqrt(n - 1)
    p = F.least(_tail(z_chi), 2 * _tail(F.abs(z_runs)), 2 * _tail(F.abs(z_lag)))
    return t.withColumn("p", F.least(F.lit(1.0), 3 * p)).drop("__k", "__n", "__squares", "__walk")


def _chosen(token: Column, value) -> Column:
    """``value(entry)`` of the narrowest encoding that has all the token's
    characters."""
    out = None
    for entry in ALPHABETS:
        hit, v = token.rlike(entry[1]), F.lit(value(entry))
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out


def _length_class(token: Column) -> Column:
    """Quarter octaves of the length."""
    return F.least(F.floor(4 * F.log2(F.length(token))).cast("int"), F.lit(LONGEST))


def decoys(words: DataFrame, strata: list[tuple[int, str]]) -> DataFrame:
    """``size, encoding, token, alphabet``: for every stratum one decoy of each
    ``JOINED`` distinct words (numbers) or so.  ``words``: ``w``, distinct."""
    form = {e[0]: e[3] for e in ALPHABETS}
    alphabet = {e[0]: WORD_ALPHABET.get(e[0], e[2]) for e in ALPHABETS}
    n = max(1, -(-words.count() // JOINED))
    some = (words.groupBy(F.pmod(F.xxhash64("w"), F.lit(n)).alias("g"), F.col("w").rlike("^[0-9]").alias("of_numbers"))
            .agg(F.sort_array(F.collect_list("w")).alias("ws")))
    title = F.transform("ws", lambda w: F.initcap(w))
    written = {"number": F.array_join("ws", ""), "lower": F.array_join("ws", ""), "upper": F.upper(F.array_join("ws", "")),
               "title": F.array_join(title, ""), "path": F.array_join(title, "/"), "slug": F.array_join("ws", "-")}
    some = some.select("g", "of_numbers", *[c.alias(name) for name, c in written.items()])
    each = F.explode(F.array(*[F.struct(F.lit(size).alias("size"), F.lit(e).alias("encoding"), F.lit(form[e]).alias("form"),
                                        F.lit(alphabet[e]).alias("alphabet"), F.lit(-int(-2 ** (size / 4) // 1)).alias("length")) for size, e in strata]))
    some = some.select("*", each.alias("s")).where((F.col("s.form") == "number") == F.col("of_numbers"))
    whole = F.coalesce(*[F.when(F.col("s.form") == name, F.col(name)) for name in written])
    some = some.select("s.*", "g", whole.alias("whole")).where(F.length("whole") >= F.col("length"))
    at = F.pmod(F.xxhash64("g", "size"), F.length("whole") - F.col("length") + 1).cast("int")
    return some.select("size", "encoding", "alphabet", F.substring("whole", at + 1, F.col("length")).alias("token"))


def limits(tokens: DataFrame, null: DataFrame, fdr: float = FDR) -> DataFrame:
    """``size, encoding, limit``: per stratum the least value class at which
    the share of false discoveries among the tokens reported is at most ``fdr``.
    Strata without decoys have none."""
    step = F.least(F.floor(F.col("p") * STEPS), F.lit(STEPS)).cast("int").alias("step")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    counts = (tokens.select("size", "encoding", step, one.alias("t"), none.alias("d"))
              .unionByName(null.select("size", "encoding", step, none.alias("t"), one.alias("d")))
              .groupBy("size", "encoding", "step").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
    every = Window.partitionBy("size", "encoding")                 # at most STEPS + 1 rows a stratum
    above = every.orderBy(F.col("step").desc())
    small = F.col("step") < SMALL
    c = counts.select("*", F.sum("t").over(above).alias("t_above"), F.sum("d").over(above).alias("d_above"),
                      F.sum("t").over(every).alias("tokens"), F.sum("d").over(every).alias("decoys"),
                      F.sum(F.when(small, F.col("t")).otherwise(0)).over(every).alias("t_small"),
                      F.sum(F.when(small, F.col("d")).otherwise(0)).over(every).alias("d_small"))
    share_small = (F.col("d_small") + 1) / (F.col("decoys") + 1)
    nulls = F.least(F.col("tokens").cast("double"), (F.col("t_small") + 1) / share_small)
    expected = nulls * (F.col("d_above") + 1) / (F.col("decoys") + 1)
    ok = ~small & (F.col("decoys") > 0) & (F.col("t_above") > 0) & (expected <= fdr * F.col("t_above"))
    return c.where(ok).groupBy("size", "encoding").agg(F.min("step").alias("limit"))


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per document row: ``doc_id``, ``base`` and ``random`` (arrays of
    ``start, kind, end``; kind by position in ``KINDS``, then random)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", row_id("doc_id", "text").alias("row"), text.alias("text"))
    rows = rows.select("doc_id", F.col("row.a").alias("a"), F.col("row.b").alias("b"),
                       *[spans(F.col("text"), pattern, group, least).alias(kind) for kind, pattern, group, least in KINDS],
                       spans(F.col("text"), TOKEN).alias("tokens"),
                       F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(DECOY), F.lit(0)), F.lower)).alias("words"))

    def as_kind(name, number):
        return F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    def part(run, pattern):
        return F.transform(spans(run["match"], pattern), lambda x: F.struct(
            (run["start"] + x["start"]).alias("start"), (run["start"] + x["end"]).alias("end"), x["match"].alias("match")))

    base = F.concat(*[as_kind(kind, i) for i, (kind, *_) in enumerate(KINDS)])
    rows = materialize(rows.select("doc_id", "a", "b", F.array_sort(base).alias("base"), "tokens", "words"))
    parts = F.array_distinct(F.flatten(F.transform("tokens", lambda r: F.concat(*[part(r, p) for p in PARTS]))))
    free = F.filter(parts, lambda s: ~F.exists("base", lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))
    token = rows.where(F.size("tokens") > 0).select("a", "b", F.explode(free).alias("s")).select("a", "b", "s.start", "s.end", F.col("s.match").alias("token"))
    token = token.withColumns({"encoding": _chosen(F.col("token"), lambda e: e[0]), "alphabet": _chosen(F.col("token"), lambda e: e[2]),
                               "size": _length_class(F.col("token"))})
    token = materialize(_with_battery(token).drop("token", "alphabet"))
    # at most a row for each encoding and length class
    strata = sorted((r["size"], r["encoding"]) for r in token.select("size", "encoding").distinct().collect())
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if not strata:
        return rows.select("doc_id", "base", empty.alias("random"))
    word = materialize(rows.select(F.explode("words").alias("w")).distinct())
    limit = limits(token, _with_battery(decoys(word, strata)), fdr)
    hit = (token.join(limit, ["size", "encoding"]).where(F.floor(F.col("p") * STEPS) >= F.col("limit"))
           .groupBy("a", "b").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("found")))
    # the longest of those within one another
    longest = F.filter("found", lambda s: ~F.exists("found", lambda x: (x["start"] <= s["start"]) & (s["end"] <= x["end"]) & (x != s)))
    hit = hit.select("a", "b", longest.alias("random"))
    return rows.join(shuffled(hit), ["a", "b"], "left").select("doc_id", "base", F.coalesce("random", empty).alias("random"))


def joined(found: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(kind) for kind, *_ in KINDS], F.lit("random"))
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per document row: ``doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_random``."""
    d = scan(docs, fdr)

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")

    return d.select("doc_id", *[count(i).alias(f"n_{kind}") for i, (kind, *_) in enumerate(KINDS)],
                    F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "random")).alias("spans"),
                    F.size("random").cast("bigint").alias("n_random"))
