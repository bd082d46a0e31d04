"""Quality rules and a hashed n-gram likelihood ratio, in built-in functions only.

Rules count words, symbols, repeated lines and repeated 8-word windows. Beside
them, words and word pairs are hashed into BUCKETS buckets; two multinomials, one
over trusted documents and one over the whole corpus, give each bucket a log
likelihood ratio; a document's score is the mean over its n-grams, shrunk towards 0
for short ones. Everything a document needs stays in its own row: texts are never
shuffled, only bucket counts are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, let

BUCKETS = 10_000
#: Additive smoothing of bucket counts, and n-grams without weight added to each document.
ALPHA, SHRINK = 1.0, 40
#: Trusted ids that one pass over the documents broadcasts; more take more passes.
PIECE = 1_000_000
#: Scores that the threshold's first count takes together.
STEP = 4096
#: Share of trusted documents that may fall below the threshold, and the gap below it.
LOSS, MARGIN = 0.001, 20_000
WINDOW = 8
#: Weights are whole millionths, so that sums don't depend on the order of addition.
UNIT = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def buckets_of(words: Column) -> Column:
    """Bucket numbers of a document's words, then of its word pairs."""

    def both(ones: Column) -> Column:
        pair = lambda b, i: F.pmod(b * 8191 + F.get(ones, i + 1) * 31 + 7, F.lit(BUCKETS))
        return F.concat(ones, F.filter(F.transform(ones, pair), lambda b: b.isNotNull()))

    return let(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")), both)


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs more than once; sorts only such documents."""

    def starts(found: Column) -> Column:
        other = lambda x, j: F.coalesce(F.get(found, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(found, lambda x, j: other(x, j - 1) | other(x, j + 1)), lambda x: x["i"]))

    def length(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(p - F.get(at, k - 1), F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    paired = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(paired, starts), length)


def rules(text: Column, words: Column) -> list[Column]:
    """The rules' counts of one text; words must be a lambda variable or a column."""
    n = F.size(words)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(_covered(x))).cast("long").alias("n_repeat_words"),
    ]


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", good: Column | None = None) -> DataFrame:
    """All ids of trusted rows, each once."""
    good = (F.col("quality") == 1) if good is None else good
    return cut(labels.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).alias("t_id")).distinct())


def _pieces(trusted: DataFrame) -> list[DataFrame]:
    """The trusted ids in parts of about PIECE ids by hash: a bound for broadcasting."""
    n = max(1, -(-trusted.count() // PIECE))
    place = F.pmod(F.xxhash64(F.lit("piece"), "t_id"), F.lit(n))
    return [trusted] if n == 1 else [trusted.where(place == k) for k in range(n)]


def fold_of(trusted_id: Column) -> Column:
    """The half of the trusted rows that a row is in."""
    return F.pmod(F.xxhash64(F.lit("half"), trusted_id), F.lit(2))


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, list[Column]]:
    """Constant arrays of each bucket's log ratio of trusted to corpus, in 1 / UNIT: for each half
    of the trusted rows that of the other half, and before these the mean of the two.

    So scores of unseen trusted rows and of all other rows are on one scale.

    Counts cover all words and pairs of all documents; only buckets are shuffled. The first
    pass counts the corpus and the first piece of the trusted ids, each further one a piece.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = lambda k: (F.col("t_id").isNotNull() & (fold_of(F.col("t_id")) == k)).cast("long").alias(f"own{k}")
    counts = None
    for k, piece in enumerate(_pieces(trusted)):
        mine = rows.join(F.broadcast(piece), F.col("doc_id") == F.col("t_id"), "inner" if k else "left")
        mine = mine.select(own(0), own(1), words_of(F.col("text")).alias("words"))
        each = mine.select("own0", "own1", F.explode(buckets_of(F.col("words"))).alias("b"))
        found = each.groupBy("b").agg(F.sum("own0").alias("t0"), F.sum("own1").alias("t1"), F.sum(F.lit(0 if k else 1)).alias("r"))  # BUCKETS rows at most
        # one pass and one broadcast at a time
        counts = found if counts is None else cut(counts).unionByName(found).groupBy("b").agg(*[F.sum(c).alias(c) for c in ("t0", "t1", "r")])
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("k"))
    counts = every.join(counts, F.col("k") == F.col("b"), "left").select("k", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("t0", "t1", "r")])
    line = counts.agg(F.sort_array(F.collect_list(F.struct("k", "t0", "t1", "r"))).alias("x"), *[F.sum(c).alias(f"s_{c}") for c in ("t0", "t1", "r")])
    log = lambda n, total: F.log((n + ALPHA) / (total + ALPHA * BUCKETS))

    def table(t, st: Column) -> Column:
        return F.transform("x", lambda x: F.when(st > 0, F.round((log(t(x), st) - log(x["r"], F.col("s_r"))) * UNIT)).otherwise(F.lit(0.0)).cast("long"))

    # twice BUCKETS numbers pass through the driver and come back as folded constants
    halves = line.select(table(lambda x: x["t1"], F.col("s_t1")).alias("w0"), table(lambda x: x["t0"], F.col("s_t0")).alias("w1")).first()
    mean = [(a + b) // 2 for a, b in zip(*halves, strict=True)]
    constant = lambda w: F.split(F.lit(",".join(map(str, w))), ",").cast("array<bigint>")
    return constant(mean), [constant(w) for w in halves]


def score(words: Column, table: Column) -> Column:
    """Mean weight of a document's n-grams in 1 / UNIT, with SHRINK n-grams of weight 0."""
    total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + F.get(table, x))
    return let(buckets_of(words), lambda b: F.floor(total(b) / (F.size(b) + SHRINK))).cast("long")


def threshold(docs: DataFrame, trusted: DataFrame, halves: list[Column], id_col: str = "doc_id", text_col: str = "text") -> int:
    """The score that all but LOSS of the trusted documents reach, less MARGIN.

    Each is scored by the half it is not in, as an unseen document would be.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    unseen = lambda w: F.when(fold_of(F.col("t_id")) == 0, score(w, halves[0])).otherwise(score(w, halves[1]))
    of_one = let(words_of(F.col("text")), lambda w: F.when(F.size(w) >= 20, unseen(w))).alias("s")
    scored = [cut(rows.join(F.broadcast(x), F.col("doc_id") == F.col("t_id")).select(of_one)) for x in _pieces(trusted)]
    least = _percentile(reduce(DataFrame.unionByName, scored), LOSS)
    return -(2**62) if least is None else int(least) - MARGIN


def _percentile(scores: DataFrame, share: float) -> float | None:
    """The exact percentile of the whole numbers s, between neighbours in proportion.

    Numbers are counted by steps, then singly within the steps of the two that decide.
    """
    step = F.floor(F.col("s") / STEP)
    scores = scores.where("s is not null")
    steps = sorted((x, n) for x, n in scores.groupBy(step.alias("x")).count().collect())  # the range of scores over STEP rows at most
    if not steps:
        return None

    def place(counts: list[tuple[int, int]], rank: int) -> tuple[int, int]:
        """The number at a 0-based rank, and the rank within that number's rows."""
        for x, n in counts:
            if rank < n:
                return x, rank
            rank -= n
        raise ValueError("rank beyond the counts")

    at = (sum(n for _, n in steps) - 1) * share
    ends = []
    for rank in (int(at), -int(-at // 1)):
        x, left = place(steps, rank)
        ends.append(place(sorted((s, n) for s, n in scores.where(step == x).groupBy("s").count().collect()), left)[0])
    return ends[0] + (ends[1] - ends[0]) * (at - int(at))


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, document (the row itself), the rules' counts, base_failed, score and kept for every row.

    Null and empty texts have no words and fail. Null and repeated ids are ordinary
    rows, repeated rows come out repeated, an empty table gives no rows; other columns may
    have any name. Without trusted documents all weights are 0 and only the rules decide.
    """
    table, halves = weights(docs, trusted, id_col, text_col)
    least = threshold(docs, trusted, halves, id_col, text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("document"))
    # one expression binds the words once; a column of words could be inlined into its uses
    rows = rows.select("doc_id", "document", let(words_of(F.col("text")), lambda w: F.struct(*rules(text, w), score(w, table).alias("score"))).alias("m"))
    # a filter on the verdict must not be pushed below the measuring and measure twice
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    failed = (F.col("m.n_words") < 20) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * 30)
    rows = rows.select("doc_id", "document", "m.*", failed.alias("base_failed"), "place")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least) & (F.col("place") >= 0)).drop("place")
