"""The whole analysis as one plan: stages are lazy, and four results are written and read back."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Pipeline
from ..operators import align, cooccurrence, discretize, enrich, flatten, labels, linking, pairs, scoring, spectral
from ..sources import writers


@dataclass
class Run:
    """One run: its folder, its settings, and what each written stage took (seconds, driver's CPU seconds and memory)."""

    spark: SparkSession
    folder: str
    cfg: Pipeline = Pipeline()
    seconds: dict[str, float] = field(default_factory=dict)
    resources: list[dict] = field(default_factory=list)

    def written(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's rows, written and read back; in strict runs an error where there are none."""
        start, cpu = time.time(), time.process_time()
        df = make()
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self.seconds[name] = time.time() - start
        self.resources.append({"stage": name, "wall_s": self.seconds[name], "driver_cpu_s": time.process_time() - cpu, "driver_max_rss_kb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss})
        out = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")
        return cooccurrence.checked(out, name) if self.cfg.strict else out

    def report(self) -> DataFrame:
        """A row a written stage."""
        return self.spark.createDataFrame(self.resources, "stage string, wall_s double, driver_cpu_s double, driver_max_rss_kb long")


def from_lines(run: Run, lines: DataFrame, dictionary_lines: DataFrame) -> DataFrame:
    """Labelled pairs from a log of JSON lines and a dictionary."""
    cfg = run.cfg
    mentions = run.written("mentions", lambda: flatten.mentions(lines, cfg.key_delimiter).withColumn("id", F.monotonically_increasing_id()))
    linked = run.written("linked", lambda: linking.link(align.linking_input(mentions), linking.last_wins(dictionary_lines), cfg=cfg.linking))
    aligned = align.by_id(mentions, linked)
    book = enrich.codebook(linked.where("umls_top_cui is not null").withColumnRenamed("id", "row_id"))
    return from_mentions(run, aligned, book)


def from_mentions(run: Run, aligned: DataFrame, book: DataFrame) -> DataFrame:
    cfg = run.cfg
    kept = discretize.supported(discretize.mapped(aligned), cfg.support.min_rows)
    own = run.written("tokens", lambda: cooccurrence.tokens(kept, cfg.cooccurrence))
    vocab = run.written("vocabulary", lambda: cooccurrence.vocabulary(own, cfg.cooccurrence))
    writers.vocabulary(vocab, f"{run.folder}/matrix")
    counted = run.written("pair_counts", lambda: cooccurrence.pair_counts(own, vocab, cfg.cooccurrence))
    upper = cooccurrence.ppmi(counted, cfg.cooccurrence.shift_k)
    matrix = run.written("matrix", lambda: cooccurrence.symmetric(upper, "v"))
    vectors = run.written("embeddings", lambda: spectral.embeddings(matrix, vocab, cfg.spectral, f"{run.folder}/spectral"))
    best = run.written("pairs", lambda: pairs.top_pairs(vectors.withColumnRenamed("idx", "row_id"), cfg.pairs))
    # scorer calls cost money and may differ between calls: written once, before anything reads them
    scored = run.written("scored", lambda: scoring.scored(scoring.records(enrich.enriched(best, book)), cfg=cfg.scoring))
    return labels.labelled(scored, cfg.labels)
