"""``python -m quillstream.cli ROOT COMMAND ...``: the pipelines from the command line, with JSON on standard output."""

from __future__ import annotations

import argparse
import json
import os
import sys


def main(args: list[str] | None = None) -> int:
    """Run one command; 0 if it ran, 1 if something it needs is missing."""
    p = argparse.ArgumentParser(prog="quillstream")
    p.add_argument("root", help="folder of the collection")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("ingest").add_argument("ids", nargs="+")
    sub.add_parser("validate")
    sub.add_parser("journals").add_argument("list", help="journal list in its text layout")
    merge = sub.add_parser("merge")
    merge.add_argument("journals", help="journal list in its text layout")
    merge.add_argument("--service", action="store_true", help="resolve citations by the remote service and not by the store")
    sub.add_parser("build")
    sub.add_parser("search").add_argument("words", nargs="+")
    sub.add_parser("convert").add_argument("pdfs", nargs="+")
    sub.add_parser("export").add_argument("file")
    a = p.parse_args(args)

    from pyspark.sql import SparkSession

    from quillstream.operators.journals import catalogue
    from quillstream.plans import pipelines as run
    from quillstream.sources import files, pdf

    spark = SparkSession.builder.appName("quillstream").getOrCreate()
    say = lambda df: [print(json.dumps(r.asDict(recursive=True), ensure_ascii=False)) for r in df.toLocalIterator()]
    try:
        if a.command == "ingest":
            say(run.ingest(spark, a.root, a.ids).orderBy("ord"))
        elif a.command == "validate":
            say(run.validate(spark, a.root))
        elif a.command == "journals":
            files.write_journals(catalogue(files.read_journal_text(spark, a.list)), f"{a.root}/journals.json")
        elif a.command == "merge":
            say(run.merge(spark, a.root, files.read_journal_text(spark, a.journals), run.ask_service if a.service else None))
        elif a.command == "build":
            say(run.build_index(spark, a.root))
        elif a.command == "search":
            say(run.query_index(spark, a.root, " ".join(a.words)))
        elif a.command == "convert":
            paths = [os.path.abspath(p) if "://" not in p else p for p in a.pdfs]
            for p_ in files.missing(spark, paths):
                print(f"File not found: {p_}", file=sys.stderr)
            print(f"Converting {len(paths)} PDFs ...", file=sys.stderr)
            say(files.write_markdown(files.convert_pdfs(files.read_pdfs(spark, paths), pdf.pdf_markdown, pdf.plain_pdf_text)))
        elif a.command == "export":
            files.write_store(run.store(spark, a.root).withColumnRenamed("reference_pmids", "references"), a.file)
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
