"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Built-in column functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketmill.llm.common import cut

#: The patterns of the base scan. Runs of characters are taken whole, so a least length in their
#: pattern finds the same as dropping short runs afterwards, without placing each short run. An assignment that
#: fails by its length still covers its text, so its length is only looked at afterwards.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: Kind: pattern, the group whose length counts (0: the pattern sees to it), and its least length.
KINDS = {"assign": (ASSIGN, 1, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
RANDOM = "random"

#: Runs of encoded characters that are tested; an encoding is inferred from the characters that occur.
SHORTEST = 20
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}"
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Encoding: pattern, alphabet, and the sums of squared and cubed character shares of ordinary words, names
#: and numbers written in it (the index of coincidence of text; for hexadecimal, digits with few letters).
PLAIN = {
    "hex": (r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]+", DIGITS + "abcdef", 0.100, 0.0120),
    "HEX": (r"(?=.*[0-9])(?=.*[A-F])[0-9A-F]+", DIGITS + "ABCDEF", 0.100, 0.0120),
    "base32": (r"(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+", UPPER + "234567", 0.060, 0.0055),
    "base36": (r"(?=.*[0-9])(?=.*[a-z])[a-z0-9]+", DIGITS + LOWER, 0.060, 0.0055),
    "BASE36": (r"(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+", DIGITS + UPPER, 0.060, 0.0055),
    "base62": (r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+", DIGITS + UPPER + LOWER, 0.055, 0.0048),
    "base52": (r"(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+", UPPER + LOWER, 0.055, 0.0048),
    "base26": (r"[a-z]+", LOWER, 0.066, 0.0060),
    "BASE26": (r"[A-Z]+", UPPER, 0.066, 0.0060),
    "base10": (r"[0-9]+", DIGITS, 0.115, 0.0145),
}
#: Where a token has separators, they are part of base64 if both cases stand in it; else the token is tested without
#: them, under a name of its own, as it is words joined by hyphens more often than a key in groups.
BASE64 = (r"(?=.*[+/_-])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+", UPPER + LOWER + DIGITS + "+/", 0.055, 0.0048)
ENCODINGS = {"base64": BASE64, **PLAIN, **{f"{name}-": rule for name, rule in PLAIN.items()}}
#: Lengths at which a stratum of candidates begins; the level of false discoveries within each stratum; and the
#: level at which a test calls a token not random.
BANDS = [20, 32, 48, 96]
FALSE_DISCOVERIES, NOT_RANDOM = 0.05, 0.001
#: Elements or characters taken at a time where the work would else grow with the square of their number.
BLOCK = 256
#: Bins of -ln p: a quarter each, up to e^-100.
BIN, LAST_BIN = 0.25, 400


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body looks at it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, combine, zero: Column) -> Column:
    """What `combine` makes of each value and all before it. Values are taken BLOCK at a time, so that the work is in
    proportion to their number, not to its square."""

    def over(xs: Column) -> Column:
        start = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))
        return F.aggregate(xs, start, lambda a, x: _let(combine(a["at"], x), lambda now: F.struct(now.alias("at"), F.concat(a["out"], F.array(now)).alias("out"))), lambda a: a["out"])

    def blocks(v: Column) -> Column:
        first = F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / BLOCK), F.lit(0)).cast("int"))
        return F.transform(first, lambda b: over(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

    def joined(parts: Column) -> Column:
        before = F.concat(F.array(zero), over(F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), zero))))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: F.transform(p, lambda x: combine(b, x))))

    return _let(values, lambda v: _let(blocks(v), joined))


def occurrences(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern that matches no empty string: array of (s, e, m), code points.

    The text between matches and the matches give the positions; a text without a match costs one search.
    """
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matched)), matched, lambda gap, m: F.struct((F.length(gap) + F.length(m)).alias("n"), m.alias("m")))
    ends = lambda found: _running(F.transform(found, lambda x: x["n"]), lambda a, x: a + x, F.lit(0))
    placed = _let(sizes, lambda found: F.zip_with(ends(found), found, lambda e, x: F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m"))))
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def base_spans(text: Column, kind: str) -> Column:
    """The matches of one kind that are long enough: array of (s, e, m)."""
    pattern, group, least = KINDS[kind]
    found = occurrences(text, pattern)
    return F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], pattern, group)) >= least) if group else found


def _upper_tail(z: Column) -> Column:
    """-ln of the normal upper tail beyond z >= 0 (Boerjesson and Sundberg's approximation, within 1 %)."""
    return z * z / 2 + F.lit(0.9189385) + F.log(0.661 * z + 0.339 * F.sqrt(z * z + 5.51))


def _p(z: Column, sides: int) -> Column:
    """p value of a normal score: both tails, or the upper one."""
    tail = F.exp(-_upper_tail(F.abs(z)))
    return F.least(F.lit(1.0), 2 * tail) if sides == 2 else F.when(z >= 0, tail).otherwise(1 - tail)


def _choose(encoding: Column, of) -> Column:
    out = F.lit(None)
    for name, (_, alphabet, s2, s3) in ENCODINGS.items():
        out = F.when(encoding == name, of(alphabet, s2, s3)).otherwise(out)
    return out


def battery(tokens: Column) -> Column:
    """The tests of an array of (s, e, m): array of (s, e, encoding, band, p_random, evidence).

    p_random: the least of three p values, times three, under uniform independent characters of the inferred
    encoding: chi-squared of the character counts, Wald-Wolfowitz runs of the alphabet's halves, correlation
    of neighbours. evidence: -ln of the chance that ordinary words and numbers of that length come out as
    evenly spread, by the chi-squared statistic's mean and variance under their own character shares; longer
    tokens can show more of it. Every token with SHORTEST characters of an encoding is tested.
    """
    bare = lambda m: F.translate(m, "+/_-", "")
    kind = lambda m: F.coalesce(*(F.when(m.rlike(f"^{pattern}$"), F.lit(name)) for name, (pattern, *_) in PLAIN.items()))

    def encoded(t: Column) -> Column:
        """The token as its encoding writes it, and the encoding's name; null where too little is left."""
        mixed = t["m"].rlike(f"^{BASE64[0]}$")
        name = F.when(mixed, "base64").when(F.length(bare(t["m"])) >= SHORTEST, F.concat(kind(bare(t["m"])), F.when(t["m"].rlike("[+/_-]"), "-").otherwise("")))
        return F.struct(t["s"].alias("s"), t["e"].alias("e"), F.when(mixed, F.translate(t["m"], "-_", "+/")).otherwise(bare(t["m"])).alias("m"), name.alias("enc"))

    named = F.filter(F.transform(tokens, encoded), lambda t: t["enc"].isNotNull())
    known = F.transform(named, lambda t: t.withField("alphabet", _choose(t["enc"], lambda a, *_: F.lit(a))).withField("n", F.length(t["m"]).cast("double")))
    coded = F.transform(
        known,
        lambda t: (
            t.withField("k", F.length(t["alphabet"]).cast("double"))
            .withField("codes", F.transform(F.split(t["m"], ""), lambda c: (F.instr(t["alphabet"], c) - 1).cast("double")))
            .withField("squares", F.aggregate(F.array_distinct(F.split(t["m"], "")), F.lit(0.0), lambda s, c: s + F.pow(t["n"] - F.length(F.replace(t["m"], c, F.lit(""))), F.lit(2))))
        ),
    )
    coded = F.transform(coded, lambda t: t.withField("mean", F.aggregate(t["codes"], F.lit(0.0), lambda s, c: s + c) / t["n"]).withField("half", F.array_join(F.transform(t["codes"], lambda c: F.when(c < t["k"] / 2, "0").otherwise("1")), "")))

    def sums(t: Column) -> Column:
        off = lambda c: c - t["mean"]
        later = F.slice(t["codes"], F.lit(2), F.length(t["m"]) - 1)
        changes = lambda pair: (t["n"] - F.length(F.replace(t["half"], F.lit(pair), F.lit("")))) / 2
        return (
            t.withField("x2", t["k"] / t["n"] * t["squares"] - t["n"])
            .withField("runs", 1 + changes("01") + changes("10"))
            .withField("ones", F.length(F.replace(t["half"], F.lit("0"), F.lit(""))).cast("double"))
            .withField("lag", F.aggregate(F.zip_with(F.slice(t["codes"], F.lit(1), F.length(t["m"]) - 1), later, lambda a, b: off(a) * off(b)), F.lit(0.0), lambda s, x: s + x))
            .withField("var", F.aggregate(t["codes"], F.lit(0.0), lambda s, c: s + off(c) * off(c)))
        )

    def scores(t: Column) -> Column:
        n, k, zeros = t["n"], t["k"], t["n"] - t["ones"]
        product = 2 * t["ones"] * zeros
        spread = product * (product - n) / (n * n * (n - 1))
        shares = lambda i: _choose(t["enc"], lambda _, s2, s3: F.lit((s2, s3)[i]))
        s2, s3 = shares(0), shares(1)
        text_sd = 2 * k / n * F.sqrt(n * (n - 1) / 2 * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2))
        return (
            t.withField("z_even", (t["x2"] - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
            .withField("z_runs", F.when(spread > 0, (t["runs"] - 1 - product / n) / F.sqrt(spread)).otherwise(F.lit(99.0)))
            .withField("z_lag", F.when(t["var"] > 0, (t["lag"] / t["var"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0)))
            .withField("z_text", (k * (1 - s2) + k * n * s2 - n - t["x2"]) / text_sd)
        )

    def verdict(t: Column) -> Column:
        p = F.least(_p(t["z_even"], 1), _p(t["z_runs"], 2), _p(t["z_lag"], 2))
        band = F.lit(BANDS[0])
        for least in BANDS[1:]:
            band = F.when(t["n"] >= least, least).otherwise(band)
        return F.struct(t["s"].alias("s"), t["e"].alias("e"), t["enc"].alias("encoding"), band.alias("band"), F.least(F.lit(1.0), 3 * p).alias("p_random"), F.when(t["z_text"] > 0, _upper_tail(t["z_text"])).otherwise(0.0).alias("evidence"))

    return F.transform(F.transform(F.transform(coded, sums), scores), verdict)


def _stratum(t: Column) -> Column:
    return F.concat_ws("/", t["encoding"], t["band"].cast("string"))


def _bin(t: Column) -> Column:
    return F.least(F.floor(t["evidence"] / BIN), F.lit(LAST_BIN)).cast("int")


def discoveries(tested: DataFrame) -> Column:
    """Benjamini and Hochberg's threshold of each stratum, as one map from stratum to the least accepted bin.

    A stratum is an encoding and a band of lengths. Its p values are counted in bins, each taken at its
    largest value, so what is gathered is one short histogram for each stratum, map-side combined.
    """
    each = tested.select(F.explode("tested").alias("t")).select(_stratum(F.col("t")).alias("stratum"), _bin(F.col("t")).alias("bin"))
    counted = each.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("stratum")
    ranked = counted.select("stratum", "bin", F.sum("n").over(group.orderBy(F.desc("bin"))).alias("rank"), F.sum("n").over(group).alias("all"))
    least = ranked.where(F.exp(-BIN * F.col("bin")) <= FALSE_DISCOVERIES * F.col("rank") / F.col("all")).groupBy("stratum").agg(F.min("bin").alias("bin"))
    return least.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "bin")))).scalar()


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, [*KINDS, RANDOM])), x["rank"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _found(least: str, tested: str) -> Column:
    """The random tokens among those tested, as (s, e), given the thresholds' column."""
    accepted = lambda t: (_bin(t) >= F.try_element_at(F.col(least), _stratum(t))) & (t["p_random"] >= NOT_RANDOM)
    return F.transform(F.filter(tested, lambda t: F.coalesce(accepted(t), F.lit(False))), _place)


def _place(x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["e"].alias("e"))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, assign, access, hex, random): arrays of (s, e) spans for each row of `docs`, code points, end exclusive.

    random: tokens whose evidence passes their stratum's threshold and that no test calls not random. A null
    text is the empty text; repeated rows, null keys and long texts are treated like any other. What is found
    goes to the shared folder, so the texts are read once; they are never shuffled.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).alias("k"), *(base_spans(whole, kind).alias(kind) for kind in KINDS), battery(occurrences(whole, TOKEN)).alias("tested"))
    read = cut(read)
    with_least = read.withColumn("least", discoveries(read))
    return with_least.select(F.col("k").alias(key), *(F.transform(kind, _place).alias(kind) for kind in KINDS), _found("least", "tested").alias(RANDOM))


def _without(text: Column, spans: Column, mark: str) -> Column:
    """A text with each group of spans that overlap or touch, in the order of their starts, as one mark.

    The text is cut into blocks once, so that a part of it is taken without a walk from its beginning.
    """

    def part(blocks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
        inside = F.substring(block(first), a % BLOCK + 1, b - a)
        across = F.concat(F.substring(block(first), a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(block(last), F.lit(1), b % BLOCK))
        return F.when(first == last, inside).otherwise(across)

    def outside(s: Column, most: Column) -> Column:
        """The stretches between groups: (a, b). most: the furthest end of each span and those before it."""
        begins = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1)["s"] > F.get(most, i - 2)))
        made = lambda g: F.transform(g, lambda i: F.struct(F.when(i == 1, 0).otherwise(F.get(most, i - 2)).alias("a"), F.get(s, i - 1)["s"].alias("b")))
        rest = F.struct(F.element_at(most, F.lit(-1)).alias("a"), F.length(text).alias("b"))
        return F.concat(made(begins), F.array(rest))

    most = lambda s: _running(F.transform(s, lambda x: x["e"]), lambda a, x: F.greatest(a, x), F.lit(0))
    kept = _let(spans, lambda s: _let(most(s), lambda m: outside(s, m)))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return _let(kept, lambda k: _let(blocks, lambda b: F.array_join(F.transform(k, lambda x: part(b, x["a"], x["b"])), mark)))


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[redacted]") -> DataFrame:
    """The rows of `docs`, all columns, with each secret of the text replaced by a mark; spans that overlap or
    touch get one mark. Null texts stay null, and no column of the rows is written over, whatever its name. The texts are read twice, for the thresholds and for the rest, and
    never shuffled or joined."""
    whole = F.coalesce(F.col(text), F.lit(""))
    tested = cut(docs.select(battery(occurrences(whole, TOKEN)).alias("tested")))
    taken = {c.lower() for c in docs.columns}
    prefix = next(p for i in range(len(taken) + 1) if not any(c.startswith(p := f"found_{i}_") for c in taken))
    own = lambda name: f"{prefix}{name}"
    staged = docs.withColumns({own("tested"): battery(occurrences(whole, TOKEN)), own("least"): discoveries(tested)})
    staged = staged.withColumn(own("spans"), F.array_sort(F.concat(*(F.transform(base_spans(whole, kind), _place) for kind in KINDS), _found(own("least"), own("tested")))))

    cleaned = _without(F.col(text), F.col(own("spans")), mark)
    return staged.withColumn(text, F.when(F.size(own("spans")) > 0, cleaned).otherwise(F.col(text))).select(*docs.columns)


def digest(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """scan()'s spans as counts, the SHA-256 of the base spans, and all spans as text."""
    ranked = lambda kind, rank: F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e")))
    base = F.concat(*(ranked(kind, i + 1) for i, kind in enumerate(KINDS)))
    counts = [F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select(key, *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.concat(base, ranked(RANDOM, len(KINDS) + 1))).alias("spans"), F.size(RANDOM).cast("bigint").alias("n_random"))
