"""Indexes 500 session files of 200 messages each and searches them: seconds to index, single queries, and many queries in one job."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from skein.api import SessionIndex

#: Words of the corpus.
CJK = ("认证", "登录", "缓存", "重试", "数据库", "并发", "权限", "部署")


def text(project: int, n: int) -> str:
    cjk = CJK[n // 20 % len(CJK)] if n % 20 == 0 else "普通"
    return f"p{project} doc-{n} keyword-{n % 997} {cjk}内容 symbol-{n % 53} file_name_{n % 17}.ts"


def write(folder: str, files: int, entries: int, projects: int) -> None:
    for f in range(files):
        head = {"type": "session", "version": 3, "id": f"s{f}", "timestamp": "2026-01-01T00:00:00Z", "cwd": f"/work/p{f % projects}"}
        rows = [{"type": "message", "id": f"e{n}", "parentId": None, "timestamp": "2026-01-01T00:00:01Z", "message": {"role": ("user", "assistant")[n % 2], "content": text(f % projects, n)}} for n in range(f * entries, (f + 1) * entries)]
        with open(f"{folder}/{f:04}.jsonl", "w") as out:
            out.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in [head, *rows])


def query(i: int) -> str:
    return CJK[i // 5 % len(CJK)] if i % 5 == 0 else f"symbol-{i % 53}" if i % 5 == 1 else f"keyword-{i % 997}"


def main(files: int = 500, entries: int = 200, singles: int = 10, many: int = 1000) -> None:
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory(prefix="spark-") as folder:
        os.mkdir(f"{folder}/in")
        write(f"{folder}/in", files, entries, 20)
        index = SessionIndex(spark, f"{folder}/index")
        index.setup([f"{folder}/in"])
        start = time.time()
        done = index.index()
        indexing = time.time() - start
        start = time.time()
        again = index.index()
        rescan = time.time() - start
        index.search(query(0)).collect()
        took = []
        for i in range(singles):
            start = time.time()
            index.search(query(i)).collect()
            took.append(time.time() - start)
        start = time.time()
        hits = index.search({i: query(i) for i in range(many)}).count()
        batch = time.time() - start
    took.sort()
    print(json.dumps({"chunks": done["chunks"], "index_s": round(indexing, 1), "rescan_s": round(rescan, 1), "unchanged": again["dispositions"].get("unchanged"), "single_p50_s": round(took[len(took) // 2], 2), "batch_queries": many, "batch_s": round(batch, 1), "batch_hits": hits}))


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
