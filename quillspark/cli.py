"""A thin command line over the library: each command is one plan over files."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession, functions as F

from quillspark.functions import chunks as K, spans as S
from quillspark.operators import chunking, markdown as M
from quillspark.operators.model import HttpChatClient
from quillspark.plans import lint_fix
from quillspark.plans.documents import converter, url_documents
from quillspark.operators.lineage import cut
from quillspark.plans.translate import Options, profile, translate
from quillspark.sources import files, reader


def session() -> SparkSession:
    return SparkSession.builder.appName("quillspark").getOrCreate()


def _text(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(f"input file not found: {path}")
    if not os.path.isfile(path):
        raise ValueError(f"input path is not a file: {path}")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _target(args: argparse.Namespace) -> str:
    if bool(args.out) == bool(args.in_place):
        raise ValueError("give either --out or --in-place")
    return args.input if args.in_place else args.out


def _model(args: argparse.Namespace) -> tuple[Callable[[], HttpChatClient], Options]:
    if not (url := os.environ.get("QUILLSPARK_MODEL_URL")) or not (key := os.environ.get("QUILLSPARK_MODEL_KEY")):
        raise ValueError("set QUILLSPARK_MODEL_URL and QUILLSPARK_MODEL_KEY")
    name = os.environ.get("QUILLSPARK_MODEL", "default")
    now = dt.datetime.now(dt.UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")
    options = Options.from_env(
        os.environ, chunk_chars=args.max_chunk_chars, concurrency=args.concurrency, outline_mode=args.prompt_outline_mode, glossary_mode=args.prompt_glossary_mode, model=name, timestamp=now
    )
    return lambda: HttpChatClient(url, name, key), options


def translate_md(args: argparse.Namespace) -> int:
    client, options = _model(args)
    row = translate(files.read_texts(session(), [args.input]), client, options, os.environ.get("QUILLSPARK_WORK"))["documents"].first()
    if row["error"]:
        raise RuntimeError(row["error"])
    files.atomic_write_text(args.out, row["text"])
    return 0


def translate_urls(args: argparse.Namespace) -> int:
    """One address or lists of them; a failure stays in its row, and any makes the exit code 1."""
    (client, options), spark = _model(args), session()
    if args.url:
        urls = spark.createDataFrame([(1, 1, args.url, 1, os.path.basename(args.out))], "list_no int, line_no long, url string, idx long, out_name string")
    else:
        urls = files.batch_paths(files.url_lists(spark, args.url_list))
    found = reader.ReaderOptions(os.environ.get("QUILLSPARK_READER_URL", ""), timeout=int(args.timeout), key=os.environ.get("QUILLSPARK_READER_KEY"))
    convert = None if args.no_snapdown_mermaid else converter(client, args.concurrency)
    docs = url_documents(urls, found, convert, concurrency=args.concurrency, keep=cut)
    done = translate(docs.where("error IS NULL").drop("error"), client, options, os.environ.get("QUILLSPARK_WORK"))["documents"]
    rows = docs.select("doc_id", "url", "out_name", F.col("error").alias("fetch_error")).join(done.select("doc_id", "text", "error"), "doc_id", "left")
    folder, failed = (os.path.dirname(os.path.abspath(args.out)) if args.url else args.out_dir), 0
    for row in rows.toLocalIterator():
        if error := row["fetch_error"] or row["error"]:
            failed += 1
            print(f"failed: {row['url']}: {error}", file=sys.stderr)
        else:
            files.atomic_write_text(os.path.join(folder, row["out_name"]), row["text"])
    return int(failed > 0)


def debug_profile(args: argparse.Namespace) -> int:
    client, options = _model(args)
    row = profile(files.read_texts(session(), [args.input]), client, options).select("error", F.to_json("profile").alias("json"), "profile.markdown").first()
    if row["error"]:
        raise RuntimeError(row["error"])
    files.atomic_write_text(args.out, row["json"])
    if args.md_out:
        files.atomic_write_text(args.md_out, row["markdown"])
    return 0


def lint_md(args: argparse.Namespace) -> int:
    """0 without issues, 1 with, 2 for wrong use; --fix writes only what came out clean."""
    docs = files.read_texts(session(), [args.input])
    strict, depth = args.strict_renderer == "on", args.max_safe_list_depth
    if args.fix:
        target = _target(args)
        fixed = lint_fix.fix(docs, strict=strict, max_depth=depth)
        docs = fixed.select("doc_id", F.col("fixed").alias("md"))
    report = M.lint_report(docs, strict=strict, max_depth=depth).first()
    if report["n_issues"]:
        print(report["report"], file=sys.stderr)
        return 1
    if args.fix:
        files.atomic_write_text(target, docs.first()["md"])
    return 0


def sanitize_md(args: argparse.Namespace) -> int:
    target = _target(args)
    files.atomic_write_text(target, files.read_texts(session(), [args.input]).select(M.sanitized(F.col("md")).alias("md")).first()["md"])
    return 0


def debug_chunk(args: argparse.Namespace) -> int:
    plan = chunking.chunk_plan(files.read_texts(session(), [args.input]), most=args.max_chunk_chars)
    rows = plan.orderBy("idx").collect()
    if rows and rows[0]["error"]:
        raise ValueError(rows[0]["error"])
    payload = [{c: r[c] for c in ("chunk_id", "source_text", "separators")} for r in rows]
    print(json.dumps(payload, ensure_ascii=True, indent=2) if args.json else "\n".join(f"{r['chunk_id']} {len(r['source_text'])}" for r in rows))
    return 0


def debug_reconstruct(args: argparse.Namespace) -> int:
    rows = chunking.parse_chunk_payload(session().createDataFrame([(1, _text(args.chunks))], "doc_id long, payload string")).orderBy("idx").collect()
    if rows and rows[0]["error"]:
        raise ValueError(rows[0]["error"])
    sys.stdout.write(K.rebuild([K.Chunk(r["chunk_id"], r["source_text"], r["separators"]) for r in rows if r["chunk_id"] is not None]))
    return 0


def debug_protect(args: argparse.Namespace) -> int:
    text, kept = S.protect(_text(args.input))
    files.atomic_write_text(args.map, json.dumps(kept, ensure_ascii=True, indent=2))
    files.atomic_write_text(args.out, text)
    return 0


def debug_restore(args: argparse.Namespace) -> int:
    kept = json.loads(_text(args.map))
    if not isinstance(kept, dict) or not all(isinstance(v, str) for v in kept.values()):
        raise S.SpanError("map must be a JSON object of strings")
    files.atomic_write_text(args.out, S.restore(_text(args.input), kept))
    return 0


def debug_fetch(args: argparse.Namespace) -> int:
    options = reader.ReaderOptions(os.environ.get("QUILLSPARK_READER_URL", ""), args.min_length, int(args.timeout), args.attempts, key=os.environ.get("QUILLSPARK_READER_KEY"))
    files.atomic_write_text(args.out, reader.fetch_one(args.url, options))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple, common: bool = False) -> None:
        sub = commands.add_parser(name)
        for flags, given in options:
            sub.add_argument(*flags.split(), **given)
        if common:
            for flags, kind, default in (("--timeout", float, 30.0), ("--max-chunk-chars", int, 8000), ("--concurrency", int, 1)):
                sub.add_argument(flags, type=kind, default=default)
            sub.add_argument("--prompt-outline-mode", choices=("headings", "full"), default="headings")
            sub.add_argument("--prompt-glossary-mode", choices=("filtered", "full"), default="filtered")
        sub.set_defaults(run=run)

    need, source, out = {"required": True}, ("--in", {"required": True, "dest": "input"}), ("--out", {"required": True})
    place = (("--out", {}), ("--in-place", {"action": "store_true"}))
    command("translate-md", translate_md, source, out, common=True)
    plain = ("--no-snapdown-mermaid", {"action": "store_true"})
    command("translate-url", translate_urls, ("--url", need), out, plain, common=True)
    command("translate-url-batch", translate_urls, ("--url-list --url-file", need | {"action": "append", "dest": "url_list"}), ("--out-dir", need), ("--url", {"help": argparse.SUPPRESS}), plain, common=True)
    command("debug-profile", debug_profile, source, out, ("--md-out", {}), common=True)
    command("lint-md", lint_md, source, ("--fix", {"action": "store_true"}), *place, ("--strict-renderer", {"choices": ("on", "off"), "default": "on"}), ("--max-safe-list-depth", {"type": int, "default": 1}))
    command("sanitize-md", sanitize_md, source, *place)
    command("debug-chunk", debug_chunk, source, ("--max-chunk-chars", {"type": int, "default": 8000}), ("--json", {"action": "store_true"}))
    command("debug-reconstruct", debug_reconstruct, ("--chunks", need))
    command("debug-protect", debug_protect, source, out, ("--map", need))
    command("debug-restore", debug_restore, source, ("--map", need), out)
    command("debug-fetch", debug_fetch, ("--url", need), out, ("--timeout", {"type": float, "default": 30.0}), ("--min-length", {"type": int, "default": 200}), ("--attempts", {"type": int, "default": 5}))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (OSError, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2 if args.command in ("lint-md", "sanitize-md") else 1


if __name__ == "__main__":
    sys.exit(main())
