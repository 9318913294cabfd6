"""Secret scan with DataFrame functions only (operator 7).

Base patterns (assignments, access keys, long hex runs) give spans by kind. The method adds spans of kind
`entropy`: candidate strings whose sliding window of WINDOW characters reaches the Shannon entropy set for
their character class, computed by incremental counts (one character enters, one leaves), unless an
allow-list pattern matches all of it. Base spans and allow-listed words are cut out of the runs beforehand:
what is left of a run on either side is a candidate of its own, if still as long as the window.

Positions are code points, end exclusive: the match k of a pattern begins after the first k+1 pieces
between matches and the k matches before it, which running sums over arrays give in n log n steps. Texts are rebuilt from pieces
that are joined once, each cut from the chunks of the text that hold it; so the work grows in proportion to text and matches.

Defined results: null or empty text: no spans, counts 0, digests of the empty string. Overlapping base
spans of different kinds all stay. redact replaces each run of overlapping spans by one mark; a null text
stays null. Rows with a null doc_id are scanned like others. Extra columns are ignored by scan and carried along by redact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32

# Parameters of the method.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes, the first that fits, and the bits a window of each must reach.
CLASSES = [("hex", r"^[0-9A-Fa-f]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^.+$", 3.8)]
#: Words of sample values: only they are no secrets, not what stands beside them.
ALLOW_WORDS = ["example", "placeholder", "changeme", "0123456789", "abcdefgh"]
#: Every x of a run of at least six.
MANY_X = "(?i)" + "|".join(f"(?<=x{{{k}}})x(?=x{{{5 - k}}})" for k in range(6))
#: Strings that look random by their kind but are no secrets.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[A-Za-z]+(?:[/_=-][A-Za-z]+)*[/_=-]?[0-9]{1,4}$",
    r"^[/_=-]*(?:[A-Za-z]{2,}|[0-9]{1,4})(?:[/_=-]+(?:[A-Za-z]{2,}|[0-9]{1,4}))+[/_=-]*$",
]

SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def once(value: Column, f) -> Column:
    """f of a value that is computed once: as the one element of an array it is a variable of the lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, combine) -> Column:
    """Running totals of an array of numbers by combine (sum or maximum): in round k every place takes in the one 2 ** k before it, n log n steps in all."""
    rounds = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1))

    def double(state: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(state, lambda x, i: F.when(i >= back, combine(x, F.get(state, i - back))).otherwise(x))

    return F.aggregate(rounds, values, double)


def _found(text: Column, pattern: str, rank: int, ok: Column | None, group: int = 0) -> Column:
    """Spans of all leftmost, non-overlapping matches that pass ok (a function of the match and its group)."""
    parts = [F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))

    def spans(v: Column) -> Column:
        steps = F.transform(v["m"], lambda m, i: (F.length(F.get(v["p"], i)) + F.length(m)).cast("bigint"))
        ends = running(steps, lambda a, b: a + b)
        each = F.arrays_zip(v["m"].alias("m"), (v["g"] if group else v["m"]).alias("g"), ends.alias("end"))
        good = F.filter(each, lambda x: ok(x["g"]))
        return F.transform(good, lambda x: F.struct((x["end"] - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), x["end"].alias("end")))

    return once(F.struct(*parts), spans)


#: Code points of the chunks that a text is cut into, so that a piece of it is found without reading it from its beginning.
CHUNK = 1024


def replaced(text: Column, spans: Column, with_what) -> Column:
    """text with with_what (a function of the code points to cover and whether the span begins a run) in place of spans, which are ordered by start and may overlap."""

    def build(v: Column) -> Column:
        def cut(at: Column, n: Column) -> Column:
            first, inside = F.floor(at / CHUNK).cast("int"), (at % CHUNK).cast("int")
            held = F.array_join(F.slice(v["chunks"], first + 1, F.floor((inside + n) / CHUNK).cast("int") + 1), "")
            return F.when(n > 0, F.substring(held, inside + 1, n.cast("int"))).otherwise(F.lit(""))

        def piece(x: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(v["reach"], i - 1)).otherwise(F.lit(0).cast("bigint"))
            start = F.greatest(at, x["start"])
            return F.concat(cut(at, start - at), with_what(F.greatest(F.lit(0).cast("bigint"), x["end"] - start), x["start"] >= at))

        last = F.element_at(v["reach"], -1)
        return F.concat(F.array_join(F.transform(v["spans"], piece), ""), cut(last, F.greatest(F.lit(0).cast("bigint"), v["size"] - last)))

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"), spans.alias("spans"), running(F.transform(spans, lambda x: x["end"]), F.greatest).alias("reach"), F.length(text).cast("bigint").alias("size")
    )
    return F.when(F.size(spans) > 0, once(parts, build)).otherwise(text)


def entropy_bits(s: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits) of any window of s, by incremental counts of the characters of ALPHABET."""

    def f(n: Column) -> Column:  # n log2 n
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def highest(codes: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            come, go = F.element_at(codes, k), F.when(k > window, F.element_at(codes, F.greatest(k - window, F.lit(1)))).otherwise(F.lit(0))
            n = state["n"]
            gone = F.when(go > 0, F.element_at(n, F.greatest(go, F.lit(1)))).otherwise(F.lit(0))
            here = F.element_at(n, come) - F.when(come == go, 1).otherwise(0)
            total = state["sum"] - f(gone) + F.when(go > 0, f(gone - 1)).otherwise(F.lit(0.0)) - f(here) + f(here + 1)
            bits = F.log2(F.lit(float(window))) - total / window
            counts = F.transform(n, lambda c, i: c + F.when(i + 1 == come, 1).otherwise(0) - F.when(i + 1 == go, 1).otherwise(0))
            return F.struct(total.alias("sum"), F.when(k >= window, F.greatest(state["best"], bits)).otherwise(state["best"]).alias("best"), counts.alias("n"))

        first = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), first, step, lambda z: z["best"])

    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))  # the places of all characters in ALPHABET
    return F.when(F.length(s) >= window, once(codes, highest)).otherwise(F.lit(0.0))


def _random(s: Column) -> Column:
    """Whether a candidate is no allow-listed string and random enough for its class (that of it without separators around it)."""
    bound, core = F.lit(CLASSES[-1][2]), F.regexp_replace(s, r"^[/=_-]+|[/_-]+$", "")
    for _, pattern, bits in reversed(CLASSES[:-1]):
        bound = F.when(core.rlike(pattern), F.lit(bits)).otherwise(bound)
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | s.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(entropy_bits(s) >= bound)


def without(text: Column, spans: Column) -> Column:
    """text with blanks, as many characters, in place of spans (ordered by start) and of allow-listed words."""
    out = replaced(text, spans, lambda n, begins: F.repeat(F.lit(" "), n.cast("int")))
    for word in ALLOW_WORDS:
        out = F.regexp_replace(out, f"(?i){word}", " " * len(word))
    return F.regexp_replace(out, MANY_X, " ")


def with_spans(docs: DataFrame, text: str = "text", name: str = "secret_spans") -> DataFrame:
    """docs with an array of spans, ordered by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    none = F.array().cast(f"array<{SPAN}>")
    has_key = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api_key") | low.contains("apikey")
    assign = F.when(has_key, _found(t, ASSIGN, 0, lambda g: F.length(g) >= ASSIGN_CHARS, group=1)).otherwise(none)
    access = F.when(t.contains("AKIA"), _found(t, ACCESS, 1, lambda m: F.length(m) >= ACCESS_CHARS)).otherwise(none)
    # Maximal runs: a run that is too short fails as a whole, so asking for the length in the pattern is the same.
    hexes = F.when(t.rlike(r"[0-9a-f]{%d}" % HEX_CHARS), _found(t, r"[0-9a-f]{%d,}" % HEX_CHARS, 2, lambda m: F.lit(True))).otherwise(none)
    base = docs.withColumn(name, F.array_sort(F.concat(assign, access, hexes)))
    base = base.withColumn(f"{name} rest", F.when(t.rlike(r"[A-Za-z0-9+/_=-]{%d}" % WINDOW), without(t, F.col(name))))
    rest = F.col(f"{name} rest")
    odd = F.when(rest.rlike(r"[A-Za-z0-9+/_=-]{%d}" % WINDOW), _found(rest, CANDIDATE, 3, _random)).otherwise(none)
    return base.withColumn(name, F.array_sort(F.concat(F.col(name), odd))).drop(f"{name} rest")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and spans of every text."""
    spans = F.col("secret_spans")
    rows = with_spans(docs.select("doc_id", "text")).select("doc_id", "secret_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    base = F.sha2(listed(F.filter(spans, lambda x: x["rank"] < 3)), 256)
    return rows.select("doc_id", *counts[:3], base.alias("base_sha256"), listed(spans).alias("spans"), counts[3])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark; n_chars, if there, follows."""
    found = with_spans(docs, name="secret spans")
    spans, text = F.col("secret spans"), F.col("text")

    out = found.withColumn("text", replaced(text, spans, lambda n, begins: F.when(begins, F.lit(mark)).otherwise(F.lit(""))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
