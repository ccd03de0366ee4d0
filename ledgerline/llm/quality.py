"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule compares a statistic of a text with a cutoff. Labelled documents (quality 1 or 0) that pass the base rule are
split by a hash of their ids: the first half proposes, the second, held out, certifies.

Proposal: in each stratum (language) a rule takes the cutoff of its grid that drops most bad documents while it drops
at most ALPHA of the good ones, the most lenient of equals; rules that drop no bad one are left out. The rules are put in
order (fewest good documents dropped, then most bad ones) and make one path: step j drops what any of the first j rules drops.

Certificate: a step is valid while the exact binomial test on the held-out half rejects "it drops at least ALPHA of the
good documents", i.e. while P(Bin(n, ALPHA) <= k) <= level for k of n good documents dropped. The path ends at the first step that isn't
(fixed sequence); what lies before it is the stratum's verdict, all its rules together. The level is DELTA divided by the number of
paths (Bonferroni), so with probability 1 - DELTA no stratum loses ALPHA of its good documents. Strata whose held-out labels
could certify nothing, which depends on their number only, share one path, and their bound holds for them together; where these
are too few together all strata share one path. Strata without a label of the held-out half have the base rule only.

Cases: a null text has no words and fails the base rule; a null stratum is one of its own; labels that are null, for
unknown documents or repeated alike count once for each equal (doc_id, quality); rows of one id are judged one by one, each by its
own text, and so are rows with a null id; an empty table gives no rows. Extra columns are ignored by ``verdicts`` and kept by ``keep_good``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BLANKS, materialize

#: Share of a stratum's good documents that its rules together may drop, and the chance that any stratum exceeds it.
ALPHA = 0.03
DELTA = 0.05
#: Strata whose paths are broadcast; more are joined by a shuffle.
STRATA_BROADCAST = 100_000
#: Column that holds a row's statistics beside its own columns.
MEASURED = "_quality_measured"
#: Cutoffs of each rule from lenient to strict; a document is dropped if its statistic is above.
RULES: dict[str, list[float]] = {
    "symbols_per_word": [2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.15, 0.1],
    "bars_per_word": [0.9, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05],
    "bangs_per_word": [2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2],
    "upper_share": [0.9, 0.7, 0.5, 0.4, 0.3],
    "repeat_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2],
    "dup_line_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2],
    "same_word_share": [0.9, 0.8, 0.7, 0.6, 0.5],
}
#: Words up to which a position fits beside 44 bits of a hash in 64 bits. Longer texts, and texts of which two different hashes
#: agree in these bits, take the wider, slower form; both give the same numbers.
SHORT = 1 << 20


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(positions: Column) -> Column:
    """Number of words in the windows of three that begin at the given ascending positions."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    step = lambda s, p: F.struct((s["n"] + F.least(F.lit(3).cast("long"), p.cast("long") - s["last"])).alias("n"), p.cast("long").alias("last"))
    return F.aggregate(positions, start, step, lambda s: s["n"])


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in windows of three found twice or more."""
    windows = F.sequence(F.lit(0), n - 3)
    hashed = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])

    # the upper 44 bits of the hash above 20 bits of position: sorting brings equal windows together
    keys = F.sort_array(F.transform(windows, lambda i: F.shiftleft(hashed(i), 20).bitwiseOR(i.cast("long"))))
    near = lambda s, x, i, to: (F.get(s, i + to).isNotNull() & (F.shiftright(F.get(s, i + to), 20) == F.shiftright(x, 20)))
    at = lambda x: x.bitwiseAND(F.lit(SHORT - 1)).cast("int")
    beside = lambda s: F.filter(s, lambda x, i: near(s, x, i, -1) | near(s, x, i, 1))
    mixed = lambda t: F.size(F.filter(t, lambda x, i: near(t, x, i, 1) & (hashed(at(x)) != hashed(at(F.get(t, i + 1)))))) > 0

    def long() -> Column:
        pairs = F.array_sort(F.transform(windows, lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))
        equal = lambda s, x, i, to: F.coalesce(F.get(s, i + to)["h"] == x["h"], F.lit(False))
        return _let(pairs, lambda s: _covered(F.array_sort(F.transform(F.filter(s, lambda x, i: equal(s, x, i, -1) | equal(s, x, i, 1)), lambda x: x["i"]))))

    short = _let(keys, lambda s: _let(beside(s), lambda t: F.when(~mixed(t), _covered(F.array_sort(F.transform(t, at))))))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(F.coalesce(F.when(n < SHORT, short), long()))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """docs with the struct MEASURED (doc_id, stratum, COUNTS and the statistic of each rule) beside each row's own columns."""
    own = docs.columns
    q = lambda name: f"_quality_{name}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(q("text"), text).withColumn(q("words"), F.regexp_extract_all(F.col(q("text")), F.lit(f"[^{BLANKS}]+"), F.lit(0)))
    without = lambda pattern: F.length(q("text")) - F.length(F.regexp_replace(q("text"), pattern, ""))
    lines = F.filter(F.split(q("text"), "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    n = F.size(q("words"))
    found = {
        "doc_id": F.col(id_col).cast("long"),
        "stratum": F.col(stratum_col).cast("string"),
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace(q("text"), f"[{BLANKS}]+", "")).cast("long"),
        "n_symbols": without("[#*$%&|<>]+").cast("long"),
        "lines": _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).alias("all"))),
        "n_repeat_words": _let(F.col(q("words")), lambda w: _repeat_words(w, F.size(w))),
        "bars": without("[|]+"),
        "bangs": without("!+"),
        "upper": without("\\p{Lu}+"),
        "same": n - F.size(F.array_distinct(q("words"))),
    }
    rows = rows.select(*own, *[v.alias(q(k)) for k, v in found.items()])
    per = lambda a, b: F.coalesce(F.try_divide(F.col(q(a)).cast("double"), b.cast("double")), F.lit(0.0))
    words, dup = F.col(q("n_words")), F.col(q("lines"))["dup"]
    shares = {
        "symbols_per_word": per("n_symbols", words),
        "bars_per_word": per("bars", words),
        "bangs_per_word": per("bangs", words),
        "upper_share": per("upper", F.col(q("word_chars"))),
        "repeat_share": per("n_repeat_words", words),
        "dup_line_share": F.coalesce(F.try_divide(dup.cast("double"), F.col(q("lines"))["all"].cast("double")), F.lit(0.0)),
        "same_word_share": per("same", words),
    }
    plain = [F.col(q(k)).alias(k) for k in ("doc_id", "stratum", "n_words", "word_chars", "n_symbols")]
    return rows.select(*own, F.struct(*plain, dup.alias("n_dup_lines"), F.col(q("n_repeat_words")).alias("n_repeat_words"), *[v.alias(k) for k, v in shares.items()]).alias(MEASURED))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, COUNTS and the statistic of each rule): one row for each row of docs."""
    return measured(docs.select(id_col, text_col, stratum_col), id_col, text_col, stratum_col).select(f"{MEASURED}.*")


def base_failed(count=F.col) -> Column:
    return (count("n_words") < 50) | (100 * count("n_repeat_words") > 50 * count("n_words"))


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), summed in logarithms."""
    n, odds = n.cast("double"), math.log(p / (1 - p))
    start = F.struct((n * math.log(1 - p)).alias("term"), (n * math.log(1 - p)).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log(n - i + 1) - F.log(i.cast("double")) + odds
        high, low = F.greatest(s["total"], term), F.least(s["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, start, step, lambda s: s["total"])


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stats of the labelled rows that pass the base rule, with quality and held (of the half that certifies)."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    rows = stats.filter(~base_failed()).join(marks, "doc_id")
    return rows.select("stratum", "quality", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).alias("held"), F.array(*RULES).alias("values"))


def _first_above(path: Column, values: Column) -> Column:
    """Number, from 1, of the first step of path that drops a row of these values; null if none does."""
    above = F.transform(path, lambda step: F.element_at(values, step["rule"]) > step["cutoff"])
    return F.nullif(F.array_position(above, True), F.lit(0).cast("long"))


def _paths(rows: DataFrame, alpha: float) -> DataFrame:
    """(stratum, path): the proposal of the first half of rows(stratum, quality, held, values); a step is struct(rule, cutoff), rule from 1."""
    tuning = rows.filter("NOT held")
    tries = [(k, i, cut) for k, grid in enumerate(RULES.values()) for i, cut in enumerate(grid)]
    dropped = lambda q, k, cut: F.sum(F.when((F.col("quality") == q) & (F.col("values")[k] > cut), 1).otherwise(0))
    counts = tuning.groupBy("stratum").agg(F.sum("quality").alias("n"), *[dropped(q, k, cut).alias(f"c{k}_{i}_{q}") for k, i, cut in tries for q in (0, 1)])
    steps = F.array(*[F.struct(F.lit(k + 1).alias("rule"), F.lit(i).alias("i"), F.lit(cut).alias("cutoff"), F.col(f"c{k}_{i}_0").alias("bad"), F.col(f"c{k}_{i}_1").alias("good")) for k, i, cut in tries])
    useful = counts.select("stratum", "n", F.explode(steps).alias("t")).select("stratum", "n", "t.*").filter(F.col("bad") > 0).filter(F.col("good") <= alpha * F.col("n"))
    best = useful.groupBy("stratum", "rule").agg(F.max(F.struct("bad", (-F.col("i")).alias("order"), "cutoff", "good")).alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("b.good"), (-F.col("b.bad")).alias("bad"), "rule", F.col("b.cutoff").alias("cutoff"))))
    return best.groupBy("stratum").agg(F.transform(ordered, lambda x: F.struct(x["rule"].alias("rule"), x["cutoff"].alias("cutoff"))).alias("path"))


def _certified(rows: DataFrame, alpha: float, level: float) -> DataFrame:
    """(stratum, path): the valid part of each stratum's path that has one; level is a logarithm."""
    paths = materialize(_paths(rows, alpha).withColumnRenamed("stratum", "s"), "quality-proposal")
    held = rows.filter("held AND quality = 1").join(_small(paths), F.col("stratum").eqNullSafe(F.col("s"))).select("stratum", "path", _first_above(F.col("path"), F.col("values")).alias("first"))
    steps = [F.count_if(F.col("first") <= j) for j in range(1, len(RULES) + 1)]
    found = held.groupBy("stratum", "path").agg(F.count(F.lit(1)).alias("n"), F.array(*steps).alias("good"))
    valid = F.transform("good", lambda k: log_binomial_tail(F.col("n"), k, alpha) <= level)
    end = F.coalesce(F.nullif(F.array_position(valid, False), F.lit(0).cast("long")).cast("int") - 1, F.lit(len(RULES)))
    return found.select("stratum", F.slice("path", F.lit(1), end).alias("path")).filter(F.size("path") > 0)


def _small(paths: DataFrame) -> DataFrame:
    """paths, broadcast if its strata are few; the join gives the same rows either way."""
    return F.broadcast(paths) if paths.limit(STRATA_BROADCAST + 1).count() <= STRATA_BROADCAST else paths


def chosen_paths(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, path): the certified rules of each stratum that has any, as struct(rule from 1, cutoff)."""
    rows = materialize(_labelled(stats, labels), "quality-labelled")
    sizes = materialize(rows.filter("held").groupBy("stratum").agg(F.sum("quality").alias("n")), "quality-sizes")
    able = lambda n, paths: n * math.log(1 - alpha) <= math.log(delta / paths)
    strata = max(1, sizes.count())
    few = sizes.filter(~able(F.col("n"), strata))
    pooled, n = few.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    paths = strata - pooled + 1 if pooled else strata
    if pooled and not able(n, paths):  # too few together as well: one path for all
        few, paths = sizes, 1
    level = math.log(delta / paths)
    names = _small(few.select(F.col("stratum").alias("s")))
    alone = rows.join(names, F.col("stratum").eqNullSafe(F.col("s")), "left_anti")
    pool = rows.join(names, F.col("stratum").eqNullSafe(F.col("s")), "left_semi").withColumn("stratum", F.lit(None).cast("string"))
    own = _certified(alone, alpha, level)
    if not pooled:
        return materialize(own, "quality-paths")
    shared = _certified(pool, alpha, level).first()  # one row at most, of as many steps as there are rules
    if shared is None:
        return materialize(own, "quality-paths")
    path = F.array(*[F.struct(F.lit(x.rule).cast("int").alias("rule"), F.lit(x.cutoff).cast("double").alias("cutoff")) for x in shared.path])
    return materialize(own.unionByName(few.select("stratum", path.alias("path"))), "quality-paths")


def _broken(path: Column, statistic=F.col) -> Column:
    """Names of the rules on path that drop the row, comma-joined."""
    values, names = F.array(*[statistic(r) for r in RULES]), F.array(*map(F.lit, RULES))
    hits = F.filter(path, lambda step: F.element_at(values, step["rule"]) > step["cutoff"])
    return F.coalesce(F.array_join(F.array_sort(F.transform(hits, lambda step: F.element_at(names, step["rule"]))), ","), F.lit(""))


def verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row for each row of docs: its counts, base_failed, kept and the rules that drop it."""
    narrow = docs.select(id_col, text_col, stratum_col)
    stats = materialize(statistics(narrow, id_col, text_col, stratum_col), "quality-stats")
    paths = chosen_paths(stats, labels, alpha, delta).select(F.col("stratum").alias("s"), "path")
    found = stats.join(_small(paths), F.col("stratum").eqNullSafe(F.col("s")), "left")
    return found.select("doc_id", *COUNTS, base_failed().alias("base_failed"), _broken(F.col("path")).alias("broken")).withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verdicts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs whose verdict is kept, judged where they are: statistics are written beside each row, and no row is joined by id."""
    rows = materialize(measured(docs, id_col, text_col, stratum_col), "quality-measured")
    paths = chosen_paths(rows.select(f"{MEASURED}.*"), labels, alpha, delta).select(F.col("stratum").alias("_quality_s"), F.col("path").alias("_quality_path"))
    m = lambda c: F.col(MEASURED)[c]
    rows = rows.join(_small(paths), m("stratum").eqNullSafe(F.col("_quality_s")), "left")
    return rows.filter(~base_failed(m) & (_broken(F.col("_quality_path"), m) == "")).select(*docs.columns)
