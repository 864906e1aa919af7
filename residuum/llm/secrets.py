"""Secret scans: three fixed patterns, and character Markov models of random strings and ordinary words.

The models are first-order chains over the letters that keys are written in. Their training labels
come from the patterns: what a pattern matched is random; words of texts without a match are ordinary, and so
are the identifiers that are made from them by a rule (numbered names, paths, dates, plain numbers), since words
alone show no digits. ``error_rates`` measures both errors on strings that the chains were not trained on.
A candidate run is a secret if the log-likelihood ratio of the two chains exceeds ``MIN_RATIO``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from residuum.llm.text import indices, let, words
from residuum.session import stage

#: The patterns, in the order in which kinds are listed.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
#: Runs of 24 and more; shorter runs fail, and a run is matched whole, so the bound can be in the pattern.
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
KINDS = ["assign", "access", "hex", "markov"]
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Letters of the chains; any other character is the state after the last.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: Bounds of the labelled sample: strings of either kind that the chains are counted on (lowest hashes).
RANDOM_SAMPLE, ORDINARY_SAMPLE = 4000, 20000
#: ln of the odds against a secret: one run in a million.
MIN_RATIO = 13.8
#: Weight of the letter frequencies in a row of a chain, in transitions.
PRIOR = 20
#: What redact() writes instead of a secret.
MASK = "[SECRET]"


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Leftmost non-overlapping matches as structs (start, rank, stop, kind, value); ``keep`` judges a match.

    The pieces between the matches and the matches alternate, so running lengths give the places.
    """
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string,value:string>>")

    def place(found: Column) -> Column:
        def of(pieces: Column) -> Column:
            begin = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

            def step(acc: Column, i: Column) -> Column:
                value = F.element_at(found, i)
                start = acc["at"] + F.length(F.element_at(pieces, i))
                stop = start + F.length(value)
                span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), stop.alias("stop"),
                                F.lit(kind).alias("kind"), value.alias("value"))
                return F.struct(stop.alias("at"), F.when(keep(value), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

            return F.aggregate(indices(1, F.size(found)), begin, step)["spans"]

        return let(F.split(text, pattern), of)

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start, then kind as listed."""
    value = F.regexp_extract
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, "assign", lambda m: F.length(value(m, "^" + ASSIGN, 2)) >= MIN_ASSIGN),
        _spans(text, ACCESS, "access", lambda m: F.length(m) >= MIN_ACCESS),
        _spans(text, HEX, "hex", lambda m: F.lit(True))))


def _state(string: Column, i: Column) -> Column:
    at = F.instr(F.lit(ALPHABET), F.substring(string, i, F.lit(1)))
    return F.when(at > 0, at - 1).otherwise(STATES - 1)


def _cells(string: Column) -> Column:
    """Transitions of a string as numbers ``from * STATES + to``."""
    return F.transform(indices(1, F.length(string) - 1), lambda i: _state(string, i) * STATES + _state(string, i + 1))


def _identifiers(word: Column) -> Column:
    """A word and ordinary identifiers made from it and its hash: a numbered name, a path, two dates, a number of 16 digits."""
    part = lambda n, at: F.pmod(F.shiftrightunsigned(F.xxhash64(word), at), F.lit(n))
    day = lambda at: F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), part(36500, at).cast("int")), "yyyy-MM-dd")
    bare = F.translate(word, ".,;:!?", "")
    return F.array(word, F.concat_ws("_", bare, part(1000, 3)), F.concat(F.lit("/"), bare, F.lit("/"), F.lower(bare), part(100, 7)),
                   F.concat_ws("-", day(0), day(20)), F.lpad(part(10 ** 16, 5).cast("string"), 16, "7"))


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct random strings and distinct ordinary words (column ``s``), labelled by the patterns."""
    text = F.coalesce("text", F.lit(""))
    has = text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX)
    marked = docs.select(text.alias("text")).where(has)
    value = lambda s: F.when(s["kind"] == "assign", F.regexp_extract(s["value"], "^" + ASSIGN, 2)).otherwise(s["value"])
    random = marked.select(F.explode(F.transform(base_spans(F.col("text")), value)).alias("s"))
    # One word in 64 of every clean text, chosen by hash, so that no long text dominates and few are exploded.
    clean = docs.select(text.alias("text")).where(~has).select(F.pmod(F.xxhash64("text"), F.lit(64)).alias("h"), words(F.col("text")).alias("w"))
    plain = clean.select(F.explode(F.filter("w", lambda w, i: (F.length(w) >= 6) & (i % 64 == F.col("h")))).alias("s"))
    return random.distinct(), plain.where(F.col("s").rlike("^[A-Za-z_-]+[.,;:!?]?$")).distinct()


def train(docs: DataFrame) -> list[float]:
    """The log-likelihood ratio of every transition, row by row.

    Both chains back off to the frequency of the letter, nine parts to one of an even share. The samples are the strings with the lowest hashes among
    all labelled ones; their bounds are parameters of this module. Only STATES * STATES sums reach the
    driver. Without a labelled string of either kind all ratios are 0 and the method adds nothing.
    """
    return fit(*labelled(docs))


def fit(random: DataFrame, plain: DataFrame) -> list[float]:
    """``train`` on labelled strings."""
    def counted(strings: DataFrame, bound: int, name: str, forms) -> DataFrame:
        # A top-k by hash is kept per task before anything is sent.
        chosen = strings.orderBy(F.xxhash64("s"), "s").limit(bound).select(F.explode(forms(F.col("s"))).alias("s"))
        return chosen.select(F.explode(_cells(F.col("s"))).alias("cell"), F.lit(name).alias("name"))

    both = counted(random, RANDOM_SAMPLE, "random", F.array).unionByName(counted(plain, ORDINARY_SAMPLE, "ordinary", _identifiers))
    sums = {(r["name"], r["cell"]): r["count"] for r in both.groupBy("name", "cell").count().collect()}
    if len({name for name, _ in sums}) < 2:
        return [0.0] * (STATES * STATES)
    cells = range(STATES)
    rows = {(name, a): sum(sums.get((name, a * STATES + b), 0) for b in cells) for name in ("random", "ordinary") for a in cells}
    letters = {(name, b): sum(sums.get((name, a * STATES + b), 0) for a in cells) for name in ("random", "ordinary") for b in cells}
    total = {name: sum(rows[name, a] for a in cells) for name in ("random", "ordinary")}

    def log_p(name, a, b):
        letter = 0.9 * letters[name, b] / total[name] + 0.1 / STATES
        return math.log((sums.get((name, a * STATES + b), 0) + PRIOR * letter) / (rows[name, a] + PRIOR))

    return [round(log_p("random", a, b) - log_p("ordinary", a, b), 6) for a in range(STATES) for b in range(STATES)]


def ratio(string: Column, table: Column) -> Column:
    """Log-likelihood ratio of a string; ``table`` is the array of ``train``."""
    return F.aggregate(_cells(string), F.lit(0.0), lambda acc, cell: acc + F.element_at(table, cell + 1))


def _table(model: list[float]) -> Column:
    return F.split(F.lit(" ".join(map(str, model))), " ").cast("array<double>")


def error_rates(docs: DataFrame) -> DataFrame:
    """One row a label (``random``, ``ordinary``): n strings long enough for a candidate, n_flagged above the ratio.

    The chains are trained on labelled strings with an even hash and judge those with an odd one. A label without strings has no row.
    """
    random, plain = labelled(docs)
    odd = F.pmod(F.xxhash64("s"), F.lit(2)) == 1
    model = fit(random.where(~odd), plain.where(~odd))
    held = random.where(odd).select("s", F.lit("random").alias("label")).unionByName(
        plain.where(odd).select(F.explode(_identifiers(F.col("s"))).alias("s"), F.lit("ordinary").alias("label")))
    held = held.where(F.col("s").rlike("^" + CANDIDATE + "$"))
    return held.groupBy("label").agg(F.count("*").alias("n"), F.count_if(let(_table(model), lambda t: ratio(F.col("s"), t) > MIN_RATIO)).alias("n_flagged"))


def all_spans(text: Column, base: Column, model: list[float]) -> Column:
    """The base spans and, beside them, candidate runs that touch none and look random."""
    table = _table(model)

    def added(spans: Column) -> Column:
        runs = _spans(text, CANDIDATE, "markov", lambda m: F.lit(True))
        free = F.filter(runs, lambda r: ~F.exists(spans, lambda s: (s["start"] < r["stop"]) & (r["start"] < s["stop"])))
        return F.array_sort(F.concat(spans, let(table, lambda t: F.filter(free, lambda r: ratio(r["value"], t) > MIN_RATIO))))

    return let(base, added)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find_secrets(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Places are code points, ends exclusive. Null and empty texts have no spans; repeated rows and ids are
    scanned each on its own; an empty table gives no rows; further columns are ignored. ``model`` is what
    ``train`` returns; by default it is trained on ``docs``.
    """
    model = train(docs) if model is None else model
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    found = found.withColumn("spans", all_spans(F.col("text"), F.col("base"), model))
    n = lambda c, kind: F.size(F.filter(c, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n("base", "assign").alias("n_assign"), n("base", "access").alias("n_access"), n("base", "hex").alias("n_hex"),
                        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), n("spans", "markov").alias("n_markov"))


def redact(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """``docs`` with each secret replaced by ``MASK`` and n_chars counted anew where a text changed; no row goes."""
    model = train(docs) if model is None else model
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    text = F.col("_doc.text")
    own = own.withColumn("_spans", F.when(text.isNotNull(), let(base_spans(text), lambda b: all_spans(text, b, model))))

    def masked(spans: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(acc: Column, s: Column) -> Column:
            # Spans may overlap (a hexadecimal value that is also assigned): they get one mask.
            gap = F.when(s["start"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK)))
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"),
                            F.concat(acc["parts"], F.coalesce(gap, F.array().cast("array<string>"))).alias("parts"))

        return let(F.aggregate(spans, begin, step), lambda out: F.concat(
            F.array_join(out["parts"], ""), F.substring(text, out["at"] + 1, F.length(text))))

    changed = F.size("_spans") > 0
    clean = F.when(changed, masked(F.col("_spans"))).otherwise(text)
    out = own.withColumn("_text", clean).withColumn("_changed", F.coalesce(changed, F.lit(False)))
    size = F.when(F.col("_changed"), F.length("_text").cast("long"))
    return out.select(*[F.col("_text").alias("text") if c == "text" else (
        F.coalesce(size, F.col("_doc.n_chars")).alias("n_chars") if c == "n_chars" else F.col(f"_doc.`{c}`")) for c in docs.columns])
