"""``python -m orevein crawl|index|page-rank|search --data DIR [--out DIR] ...``"""

from __future__ import annotations

import argparse
import json

from .plans import pipelines
from .plans.engine import SearchEngine
from .session import get_spark, on_workers
from .sources.files import stop_words


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orevein")
    modes = parser.add_subparsers(dest="mode", required=True)
    for name in ("crawl", "index", "page-rank", "search"):
        mode = modes.add_parser(name)
        mode.add_argument("--data", required=True, help="folder of the tables")
        if name != "search":
            mode.add_argument("--out", required=True, help="folder for the new snapshots")
    modes.choices["crawl"].add_argument("--seeds", required=True, help="file of lines: address, space, depth")
    modes.choices["crawl"].add_argument("--robots", help="table of robots bodies (base, body)")
    modes.choices["crawl"].add_argument("--depth", type=int, default=3)
    modes.choices["index"].add_argument("--stop-words", help="file with one word in a line")
    modes.choices["search"].add_argument("--query", required=True)
    modes.choices["search"].add_argument("--page", type=int, default=1)
    given = parser.parse_args(arguments)
    spark = get_spark()
    on_workers(spark)
    if given.mode == "crawl":
        pipelines.crawl_tables(spark, given.data, given.out, given.seeds, given.robots, given.depth)
    elif given.mode == "index":
        pipelines.index_tables(spark, given.data, given.out, *([stop_words(spark, given.stop_words)] if given.stop_words else []))
    elif given.mode == "page-rank":
        pipelines.rank_tables(spark, given.data, given.out)
    else:
        found = SearchEngine.over(spark, given.data).search(given.query, given.page)
        print(json.dumps({"results": found.results, "total_pages": found.total_pages, "total_documents": found.total_documents}, ensure_ascii=False))


if __name__ == "__main__":
    main()
