"""Command line: ingest, query, lint (X1-X4, SK8, SK10, T7)."""

from __future__ import annotations

import argparse
import json
import sys

from scriptorium.functions.text import positive_int


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptorium", description="corpus preparation, retrieval and linting on Spark")
    sub = p.add_subparsers(dest="verb", required=True)
    a = sub.add_parser("ingest", help="a directory of .txt files to chunks, weights, entities and summaries")
    a.add_argument("input_dir")
    a.add_argument("output_dir")
    a.add_argument("--skip-wiki", action="store_true")
    a.add_argument("--max-llm-calls", type=int)
    a.add_argument("--force-regenerate", action="store_true")
    a.add_argument("--retry-failed", action="store_true")
    a.add_argument("--llm-backend", default="offline", choices=("offline", "anthropic", "ollama", "openai"))
    a.add_argument("--llm-model")
    a.add_argument("--llm-parallelism", type=positive_int)
    a.add_argument("--analyzer-backend", choices=("rules", "electra", "ginza"), default="rules")
    a.add_argument("--device", choices=("cpu", "mps", "cuda"), default="cpu")
    a.add_argument("--format", choices=("human", "json"), default="human")
    a.add_argument("--quiet", action="store_true")
    a.add_argument("--no-progress", action="store_true")
    q = sub.add_parser("query", help="the best chunks for a text")
    q.add_argument("output_dir")
    q.add_argument("text")
    q.add_argument("--top-k", type=positive_int, default=5)
    q.add_argument("--format", choices=("human", "json"))
    c = sub.add_parser("lint", help="the health of a corpus")
    c.add_argument("output_dir")
    c.add_argument("--format", choices=("human", "json"), default="human")
    c.add_argument("--pairwise-threshold", type=int, default=2000)
    c.add_argument("--duplicate-cosine", type=float, default=0.95)
    c.add_argument("--degenerate-l2", type=float, default=1e-6)
    c.add_argument("--degenerate-nnz", type=int, default=3)
    c.add_argument("--levenshtein-ratio", type=float, default=0.85)
    c.add_argument("--target-chunk-chars", type=positive_int, default=500)
    c.add_argument("--max-chunk-chars", type=positive_int, default=1500)
    return p


def format_hits(hits: list[dict]) -> str:
    """SK10, T7, W3."""
    lines = []
    for h in hits:
        words = ", ".join(k["term"] for k in h["top_keywords"][:5])
        lines.append(f"{h['rank']}. {h['score']:.4f} {h['source']} [{words}]\n   " + h["text"][:200].replace("\n", " "))
    return "\n".join(lines)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = build_parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from scriptorium.operators.lint import Thresholds
    from scriptorium.plans import ingest
    from scriptorium.progress import Progress

    spark = spark or SparkSession.builder.appName("scriptorium").getOrCreate()
    if args.verb == "ingest":
        cfg = ingest.IngestConfig(skip_summaries=args.skip_wiki, max_calls=args.max_llm_calls, force=args.force_regenerate, retry_failed=args.retry_failed, backend=args.llm_backend, model=args.llm_model, parallelism=args.llm_parallelism, analyzer_backend=args.analyzer_backend, device=args.device, progress=Progress(enabled=not (args.quiet or args.no_progress)))
        result = ingest.ingest(spark, args.input_dir, args.output_dir, cfg)
        if args.format == "json":
            print(json.dumps({"exit_code": result.exit_code, "warnings": result.warnings, **result.counters}, ensure_ascii=False))
        elif not args.quiet:
            print("\n".join([*(f"{k}: {v}" for k, v in result.counters.items()), *(f"warning: {w}" for w in result.warnings)]))
        return result.exit_code
    if args.verb == "query":
        result = ingest.query(spark, args.output_dir, args.text, args.top_k)
        if result.exit_code:
            print(result.message, file=sys.stderr)
        elif (args.format or ("human" if sys.stdout.isatty() else "json")) == "json":
            print(json.dumps(result.hits, ensure_ascii=False))
        else:
            print(format_hits(result.hits))
        return result.exit_code
    t = Thresholds(pairwise=args.pairwise_threshold, cosine=args.duplicate_cosine, degenerate_l2=args.degenerate_l2, degenerate_terms=args.degenerate_nnz, name_ratio=args.levenshtein_ratio, target=args.target_chunk_chars, limit=args.max_chunk_chars)
    code, found = ingest.run_lint(spark, args.output_dir, t, args.format == "json")
    rows = found.orderBy("check_order", "message").collect()
    print(json.dumps([r.asDict() for r in rows], ensure_ascii=False) if args.format == "json" else "\n".join(f"{r['severity']}: {r['category']}: {r['message']} {r['detail']}".rstrip() for r in rows))
    return code


if __name__ == "__main__":
    sys.exit(main())
