"""Command line: link tables, score pairs, or run the whole analysis.

    python -m mentionforge.cli link --input t.csv --dictionary terms.txt --output out.csv
    python -m mentionforge.cli link --folder in/ --output out/ --dictionary terms.txt --skip-existing
    python -m mentionforge.cli score --input pairs.csv --output scored/ --audit audit/
    python -m mentionforge.cli run --input logs.jsonl --dictionary terms.txt --output runs/

Ends with 0, with 2 where an input or key is missing, and with 1 after any other error.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from .config import Cooccurrence, Labels, Linking, Pipeline, Scoring, Spectral, Support, TopPairs
from .operators import linking, scoring
from .plans import pipeline
from .shared import needed, resolved, run_folder, secret
from .sources import readers, writers
from .telemetry import Sampler


def _link_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--dictionary", required=True, help="lines of code||term||type")
    p.add_argument("--top-k", type=int, default=Linking.top_k)
    p.add_argument("--threshold", type=float, default=Linking.threshold)
    p.add_argument("--max-chars", type=int, default=None, help="encode no more of a text than this; whole texts by default")
    p.add_argument("--dims", type=int, default=Linking.dims)
    p.add_argument("--use-cells", action="store_true", help="approximate search above --cells-above terms")
    p.add_argument("--cells-above", type=int, default=Linking.cells_above)
    p.add_argument("--cache", help="folder for the dictionary's vectors")


def _linking(a: argparse.Namespace) -> Linking:
    return Linking(top_k=a.top_k, threshold=a.threshold, max_chars=a.max_chars, dims=a.dims, use_cells=a.use_cells, cells_above=a.cells_above)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mentionforge", description=__doc__.splitlines()[0])
    p.add_argument("--base", default=".", help="what relative paths are taken from")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)

    link = sub.add_parser("link", help="concepts for the texts of a table, or of all tables of a folder")
    where = link.add_mutually_exclusive_group(required=True)
    where.add_argument("--input")
    where.add_argument("--folder")
    link.add_argument("--output", required=True)
    link.add_argument("--text", default="entity")
    link.add_argument("--glob", default="*.csv")
    link.add_argument("--sep")
    link.add_argument("--encoding")
    link.add_argument("--skip-existing", action="store_true")
    _link_flags(link)

    score = sub.add_parser("score", help="scores for pairs of concepts")
    score.add_argument("--input", required=True)
    score.add_argument("--output", required=True)
    score.add_argument("--sep")
    score.add_argument("--model", default=Scoring.model)
    score.add_argument("--temperature", type=float, default=Scoring.temperature)
    score.add_argument("--concurrency", type=int, default=Scoring.concurrency)
    score.add_argument("--max-retries", type=int, default=Scoring.max_retries)
    score.add_argument("--first-wait", type=float, default=Scoring.first_wait)
    score.add_argument("--longest-wait", type=float, default=Scoring.longest_wait)
    score.add_argument("--audit")
    score.add_argument("--requests-only", action="store_true", help="write the batch file instead of scoring")
    score.add_argument("--key-name", help="environment variable of the scorer's key; unset for the offline scorer")
    score.add_argument("--key-file")
    for c in ("pair_id", *scoring.SIDES):
        score.add_argument(f"--{c.replace('_', '-')}-column", dest=f"col_{c}", default=c)

    run = sub.add_parser("run", help="from extraction logs to labelled pairs")
    run.add_argument("--input", required=True)
    run.add_argument("--output", required=True, help="a folder of its own is made in it for each run")
    run.add_argument("--min-rows", type=int, default=Support.min_rows)
    run.add_argument("--statuses", default=None, help="names divided by commas; ALL or nothing for all")
    run.add_argument("--present-only", action="store_true")
    run.add_argument("--min-patients", type=int, default=Cooccurrence.min_patients)
    run.add_argument("--min-cooccur", type=int, default=Cooccurrence.min_cooccur)
    run.add_argument("--cap", type=int, default=Cooccurrence.cap)
    run.add_argument("--k", type=int, default=Spectral.k)
    run.add_argument("--which", choices=["LA", "LM", "SA"], default=Spectral.which)
    run.add_argument("--tol", type=float, default=Spectral.tol)
    run.add_argument("--ncv", type=int, default=None)
    run.add_argument("--seed", type=int, default=Spectral.seed)
    run.add_argument("--save-matrix", action="store_true")
    run.add_argument("--top-pp", type=int, default=500)
    run.add_argument("--top-other", type=int, default=50)
    run.add_argument("--low", type=float, default=20.0)
    run.add_argument("--high", type=float, default=80.0)
    run.add_argument("--strict", action="store_true", help="fail where a stage leaves nothing")
    run.add_argument("--telemetry", help="CSV file for samples of the driver's load")
    _link_flags(run)
    return p


def _do_link(spark: SparkSession, a: argparse.Namespace, path) -> None:
    needed(spark, path(a.input or a.folder), path(a.dictionary))
    terms = linking.last_wins(readers.dictionary_lines(spark, path(a.dictionary)))
    cache = path(a.cache) if a.cache else None
    if a.folder:
        linking.link_folder(spark, path(a.folder), path(a.output), terms, a.text, a.glob, _linking(a), a.skip_existing, cache)
    else:
        df = readers.delimited(spark, path(a.input), sep=a.sep, encoding=a.encoding)
        writers.delimited(linking.link(df, terms, a.text, _linking(a), cache=cache), path(a.output))


def _do_score(spark: SparkSession, a: argparse.Namespace, path, ask) -> None:
    needed(spark, path(a.input))
    if a.key_name:
        secret(a.key_name, a.key_file)
    cfg = Scoring(a.model, a.temperature, a.concurrency, a.max_retries, a.first_wait, a.longest_wait)
    rows = scoring.records(readers.delimited(spark, path(a.input), sep=a.sep), {c: getattr(a, f"col_{c}") for c in ("pair_id", *scoring.SIDES)})
    if a.requests_only:
        scoring.batch_requests(rows, cfg).select("value").write.mode("overwrite").text(path(a.output))
        return
    # calls may cost money and differ: written once, then read by the table and the audit
    scoring.scored(rows, ask, cfg).write.mode("overwrite").parquet(f"{path(a.output)}/scored")
    done = scoring.by_id_text(spark.read.parquet(f"{path(a.output)}/scored"))
    writers.delimited(done, f"{path(a.output)}/table.csv")
    if a.audit:
        scoring.audit(done).write.mode("overwrite").text(path(a.audit))


def _do_run(spark: SparkSession, a: argparse.Namespace, path) -> None:
    needed(spark, path(a.input), path(a.dictionary))
    cfg = Pipeline(
        linking=_linking(a),
        support=Support(a.min_rows),
        cooccurrence=Cooccurrence(statuses=Cooccurrence.parse_statuses(a.statuses), present_only=a.present_only, min_patients=a.min_patients, min_cooccur=a.min_cooccur, cap=a.cap),
        spectral=replace(Spectral(), k=a.k, which=a.which, tol=a.tol, ncv=a.ncv, seed=a.seed, save_matrix=a.save_matrix),
        pairs=TopPairs(top_pp=a.top_pp, top_other=a.top_other),
        labels=Labels(low=a.low, high=a.high),
        strict=a.strict,
    )
    own = pipeline.Run(spark, run_folder(path(a.output)), cfg)
    out = pipeline.from_lines(own, readers.lines(spark, path(a.input)), readers.dictionary_lines(spark, path(a.dictionary)))
    writers.delimited(out, f"{own.folder}/labelled.csv")
    own.report().write.mode("overwrite").json(f"{own.folder}/resources")
    print(own.folder)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, ask=scoring.rule_scorer) -> int:
    a = parser().parse_args(argv)
    try:
        builder = SparkSession.builder.appName("mentionforge")
        spark = spark or (builder.master(a.master) if a.master else builder).getOrCreate()
        path = lambda p: resolved(p, a.base)
        if a.command == "link":
            _do_link(spark, a, path)
        elif a.command == "score":
            _do_score(spark, a, path, ask)
        elif a.telemetry:
            with Sampler(a.telemetry):
                _do_run(spark, a, path)
        else:
            _do_run(spark, a, path)
    except FileNotFoundError as e:
        print(f"not found: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # whatever went wrong, the caller learns it from the code and one line
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2 if isinstance(e, KeyError) and a.command == "score" else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
