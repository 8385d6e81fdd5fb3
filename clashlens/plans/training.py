"""Training-set preparation and the pair classifier (S-2, L-3..L-7, T-9, A-1..A-9, S-9).

Row order matters in the reference (head, first appearance, shuffled batches), and Spark rows have
none, so every row carries ``(source_ord, sample_ord)`` and every "first k" is an explicit order
plus the distributed row number of ``operators.ranking`` (never a single-task global window).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clashlens.config import (BATCH_SIZE, MNLI_LIMIT, NLI_HEAD_LIMIT, NUM_PARAPHRASES, PARAPHRASE_PROMPT,
                              PARAPHRASE_SENTENCE_LIMIT, SAMPLE_SEED, SNLI_LIMIT, WARMUP_FRACTION)
from clashlens.functions.text import WS, has_negation, strip, tokens
from clashlens.operators.ranking import hash_numbers, row_number
from clashlens.operators.sentences import sentence_arrays
from clashlens.operators.similarity import aligned_features
from clashlens.sources.documents import consecutive_sentence_pairs, consecutive_turn_pairs, pair_source, valid_only
from clashlens.session import ensure_checkpoint_dir
from clashlens.sources.tables import read_table

# Names and order of the two NLI-shaped sources derived from the driver tables.
NLI_SOURCES = ("documents", "conversations")


def hex_bucket_label(key) -> F.Column:
    """Deterministic label in {-1, 0, 1, 2} from the first hex digit of md5(key); -1 rows are invalid."""
    d = F.conv(F.substring(F.md5(key), 1, 1), 16, 10).cast("int")
    return (F.pmod(d, F.lit(4)) - 1).cast("int")


def nli_rows_from_tables(spark, sf_dir: str) -> DataFrame:
    """(source, source_ord, key, premise, hypothesis, label): consecutive sentences of documents and
    consecutive turns of conversations, label derived from md5 of the row key."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    a = consecutive_sentence_pairs(sentence_arrays(docs)).select(
        F.lit(NLI_SOURCES[0]).alias("source"), F.lit(0).alias("source_ord"),
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("idx").cast("string")).alias("key"),
        F.col("sentence1").alias("premise"), F.col("sentence2").alias("hypothesis"))
    turns = valid_only(pair_source(consecutive_turn_pairs(read_table(spark, sf_dir, "conversations")),
                                   keys=("conv_id", "turn")))
    b = turns.select(
        F.lit(NLI_SOURCES[1]).alias("source"), F.lit(1).alias("source_ord"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        F.col("sentence1").alias("premise"), F.col("sentence2").alias("hypothesis"))
    rows = a.unionByName(b)
    return rows.withColumn("label", hex_bucket_label(F.concat_ws(":", "source", "key")))


def valid_labels(rows: DataFrame) -> DataFrame:
    """L-3: keep labels 0, 1, 2 (filter before sampling, as the reference does)."""
    return rows.where(F.col("label").isin(0, 1, 2))


def seeded_hash(seed: int = SAMPLE_SEED, source: str = "source", key: str = "key") -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(source), F.col(key)))


def seeded_sample(rows: DataFrame, limits: dict, seed: int = SAMPLE_SEED, group: str = "source_ord",
                  key: str = "key") -> DataFrame:
    """L-4: per ``group``, exactly min(limit, rows) rows, chosen by the order of md5(seed:source:key).

    Adds ``sample_ord`` (1-based position in the seeded order within the group). Only rows of the hash
    buckets up to the one in which a group's limit falls are sorted (``ranking.hash_numbers``).
    """
    limit = F.lit(0)
    for g, n in limits.items():
        limit = F.when(F.col(group) == g, F.lit(n)).otherwise(limit)
    return hash_numbers(rows.withColumn("_h", seeded_hash(seed, key=key)), "_h", [key], "sample_ord", [group], limit).drop("_h")


def load_nli(spark, sf_dir: str, snli_limit: int = SNLI_LIMIT, mnli_limit: int = MNLI_LIMIT,
             seed: int = SAMPLE_SEED) -> DataFrame:
    """S-2 + L-5: both sources filtered, sampled and concatenated (UNION ALL, order kept as columns)."""
    return seeded_sample(valid_labels(nli_rows_from_tables(spark, sf_dir)), {0: snli_limit, 1: mnli_limit}, seed)


def head(df: DataFrame, k: int, order=("source_ord", "sample_ord"), out: str = "row_ord") -> DataFrame:
    """L-6: the first k rows in ``order`` (distributed row number, then a filter)."""
    return row_number(df, list(order), out).where(F.col(out) <= F.lit(k))


def head_by_rank(df: DataFrame, k: int, group: str = "source_ord", rank: str = "sample_ord",
                 out: str = "row_ord") -> DataFrame:
    """L-6 when ``rank`` is already dense (1..n) inside each ``group``: no sort at all.

    Position = rows of the earlier groups + rank. Group sizes are one small aggregation (one row per
    group), which Spark joins by their size; the filter then keeps the first k rows.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(group, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_off"))
    return (df.join(offs, group).withColumn(out, F.col("_off") + F.col(rank))
            .where(F.col(out) <= F.lit(k)).drop("_off"))


def distinct_first(rows: DataFrame, col: str = "premise", seed: int = SAMPLE_SEED, group: str = "source_ord",
                   key: str = "key") -> DataFrame:
    """L-7: distinct values of ``col`` over all ``rows`` in order of first appearance: (first_ord, col), 1-based.

    Rows are in the order of their group, then of the seeded hash. The first appearance of a value is an
    aggregation; places are counted by hash buckets, and groups follow each other.
    """
    hashed = rows.withColumn("_h", seeded_hash(seed, key=key))
    firsts = (hashed.groupBy(col).agg(F.min(F.struct(F.col(group).alias("g"), F.col("_h").alias("h"), F.col(key).alias("k"))).alias("_f"))
              .select(col, F.col("_f.g").alias("_g"), F.col("_f.h").alias("_h"), F.col("_f.k").alias("_k")))
    return hash_numbers(firsts, "_h", ["_k"], "first_ord", lead=["_g"]).select("first_ord", col)


def paraphrase_prompt(sentence) -> F.Column:
    """T-9: the generator's input text."""
    return F.concat(F.lit(PARAPHRASE_PROMPT), sentence)


def builtin_paraphrases(sentences: DataFrame, n: int = NUM_PARAPHRASES, col: str = "sentence") -> DataFrame:
    """A-1/A-2 built-in generator: (sentence, rank, paraphrase), up to n per sentence, from n+2 beams.

    Beam k (1 <= k <= n+2) drops the k-th word of the prompt's sentence; beams are ranked by length
    (longest first), then k, and the top n kept. Runs in the row: no shuffle, no window.
    """
    df = sentences.select(col, paraphrase_prompt(F.col(col)).alias("_prompt"))
    df = df.withColumn("_w", F.split(strip(F.expr(f"substring(_prompt, {len(PARAPHRASE_PROMPT) + 1})")), f"{WS}+"))
    w = F.col("_w")
    beams = F.transform(F.sequence(F.lit(1), F.lit(n + 2)), lambda k: F.struct(
        k.alias("k"), F.array_join(F.concat(F.slice(w, F.lit(1), k - 1), F.slice(w, k + 1, F.size(w) + 1)), " ").alias("text")))
    df = df.withColumn("_b", beams)
    df = df.withColumn("_b", F.filter("_b", lambda b: (b["k"] <= F.size(w)) & (b["text"] != "")))
    df = df.withColumn("_b", F.slice(F.array_sort(F.transform("_b", lambda b: F.struct(
        (-F.length(b["text"])).alias("neglen"), b["k"].alias("k"), b["text"].alias("text")))), 1, n))
    return (df.select(col, F.posexplode_outer("_b").alias("_r", "_x")).where(F.col("_x").isNotNull())
            .select(col, (F.col("_r") + 1).alias("rank"), F.col("_x.text").alias("paraphrase")))


def paraphrase_lookup(requests: DataFrame, cache: DataFrame, n: int = NUM_PARAPHRASES, generator=None,
                      col: str = "sentence") -> DataFrame:
    """P-7/A-3: paraphrases for each distinct requested sentence; cached ones are read, others generated.

    A sentence is a hit when the cache holds at least n ranks for it (a shorter cached list is
    regenerated). Misses = distinct requests anti-joined with hits; the generator sees each missing
    sentence once. Output (sentence, rank, paraphrase, from_cache) with rank <= n.
    """
    gen = generator or (lambda s: builtin_paraphrases(s, n, col))
    wanted = requests.select(col).distinct()
    hits = cache.groupBy(col).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= n).select(col)
    hit_rows = (cache.join(wanted.join(hits, col, "left_semi"), col, "left_semi")
                .where(F.col("rank") <= n).withColumn("from_cache", F.lit(True)))
    misses = wanted.join(hits, col, "left_anti")
    fresh = gen(misses).where(F.col("rank") <= n).withColumn("from_cache", F.lit(False))
    return hit_rows.select(col, "rank", "paraphrase", "from_cache").unionByName(
        fresh.select(col, "rank", "paraphrase", "from_cache"))


def augment(sentences: DataFrame, n: int = NUM_PARAPHRASES, generator=None, col: str = "sentence") -> DataFrame:
    """A-4: (sentence, rank, paraphrase) for every input row, duplicates kept (a join back to the rows)."""
    gen = generator or (lambda s: builtin_paraphrases(s, n, col))
    para = gen(sentences.select(col).distinct())
    return sentences.join(para, col)


def training_set(nli: DataFrame, head_limit: int = NLI_HEAD_LIMIT, paraphrase_limit: int = PARAPHRASE_SENTENCE_LIMIT,
                 n: int = NUM_PARAPHRASES, generator=None) -> DataFrame:
    """A-5/A-6/A-9: (part, ord, s1, s2, label): the first NLI rows plus paraphrase pairs labelled 0.

    The 200-sentence limit is applied before generation. The sampled rows, which the limits of the sources
    bound, are written once to the shared checkpoint folder: three steps read them.
    """
    ensure_checkpoint_dir(nli.sparkSession)
    nli = nli.checkpoint(eager=True)
    first = head_by_rank(nli, head_limit).select(F.lit(0).alias("part"), F.col("row_ord").alias("ord"),
                                         F.col("premise").alias("s1"), F.col("hypothesis").alias("s2"),
                                         F.col("label").cast("int").alias("label"))
    sents = distinct_first(nli).where(F.col("first_ord") <= F.lit(paraphrase_limit))
    aug = augment(sents.withColumnRenamed("premise", "sentence"), n, generator)
    aug = aug.select(F.lit(1).alias("part"), ((F.col("first_ord") - 1) * n + F.col("rank")).cast("long").alias("ord"),
                     F.col("sentence").alias("s1"), F.col("paraphrase").alias("s2"), F.lit(0).alias("label"))
    return first.unionByName(aug)


def training_shards(train: DataFrame, seed: int = SAMPLE_SEED, size: int = BATCH_SIZE) -> DataFrame:
    """A-7: seeded shuffle into shards of ``size`` rows: adds ``shuffle_ord`` and ``shard``."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("part").cast("string"), F.col("ord").cast("string")))
    r = hash_numbers(train.withColumn("_h", h), "_h", ["part", "ord"], "shuffle_ord")
    return r.withColumn("shard", F.floor((F.col("shuffle_ord") - 1) / F.lit(size)).cast("long")).drop("_h")


def write_shards(shards: DataFrame, path: str, files: int | None = None, fmt: str = "parquet") -> None:
    """Shards in order, many to a file: ranges of ``shard`` with the shard as a column."""
    n = files or int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards.repartitionByRange(n, "shard").sortWithinPartitions("shard", "shuffle_ord").write.mode("overwrite").format(fmt).save(path)


def schedule(n_rows: int, size: int = BATCH_SIZE, warmup_fraction: float = WARMUP_FRACTION) -> tuple[int, int]:
    """Steps of one epoch and warm-up steps: ceil(n / size), int(0.1 * steps)."""
    steps = -(-n_rows // size)
    return steps, int(warmup_fraction * steps)


def rule_labels(train: DataFrame) -> DataFrame:
    """The training set with labels that its texts bear out, as the driver tables have no labelled pairs:
    2 where one side alone has a negation word, else 0 where the sides share a word, else 1."""
    d = train.withColumn("_a", tokens(F.col("s1"))).withColumn("_b", tokens(F.col("s2")))
    return d.withColumn("label", F.when(has_negation(F.col("_a")) != has_negation(F.col("_b")), 2)
                        .when(F.arrays_overlap("_a", "_b"), 0).otherwise(1)).drop("_a", "_b")


FEATURES = ("cos", "jac", "negf")


def pair_features(train: DataFrame) -> DataFrame:
    f = aligned_features(train, "s1", "s2")
    return f.withColumn("negf", F.col("neg").cast("double"))


def fit_pair_classifier(train: DataFrame, max_iter: int = 50) -> PipelineModel:
    """A-8: multinomial logistic regression over native pair features, fitted by Spark ML (distributed)."""
    return fit_features(pair_features(train), max_iter)


def fit_features(features: DataFrame, max_iter: int = 50) -> PipelineModel:
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
                            LogisticRegression(family="multinomial", labelCol="label", maxIter=max_iter)])
    return pipe.fit(features)


def save_model(model: PipelineModel, path: str) -> None:
    """S-9 sink."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """S-9 source."""
    return PipelineModel.load(path)
