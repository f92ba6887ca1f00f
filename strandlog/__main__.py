"""Command line: ingest, replay, info, verify, repair, merge, index, export. Exit 64 for wrong usage."""

from __future__ import annotations

import argparse
import json
import sys
import time

COMMANDS = ("ingest", "replay", "info", "verify", "repair", "merge", "index", "export")


class Usage(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        print(message, file=sys.stderr)
        raise SystemExit(64)


def ingest_words(words: list[str]) -> dict:
    """OUT from SOURCE [DETAIL] as FORMAT [type LABEL] [rotate CLAUSE]"""
    from .functions.scalars import LABELS, rotate_clause
    from .sources.inputs import KINDS

    out = {"out": words[0] if words else "", "detail": "", "label": "", "rotate": rotate_clause("off")}
    try:
        if words[1] != "from" or words[2] not in KINDS:
            raise ValueError("from and a source are wanted")
        out["source"], rest = words[2], words[3:]
        if rest and rest[0] != "as":
            out["detail"], rest = rest[0], rest[1:]
        if rest[0] != "as" or rest[1] not in (*LABELS, "auto"):
            raise ValueError("as and a format are wanted")
        out["format"], rest = rest[1], rest[2:]
        while rest:
            if rest[0] == "type":
                out["label"] = rest[1]
            elif rest[0] == "rotate":
                out["rotate"] = rotate_clause(rest[1])
            else:
                raise ValueError(f"unknown word: {rest[0]}")
            rest = rest[2:]
    except IndexError:
        raise ValueError("words are missing") from None
    out["label"] = out["label"] or LABELS.get(out["format"], "bytes_v1")
    return out


def main(argv: list[str] | None = None) -> int:
    p = Usage(prog="strandlog")
    p.add_argument("--version", "-V", action="version", version="0.1")
    sub = p.add_subparsers(dest="command", required=True, parser_class=Usage)
    for name in COMMANDS:
        c = sub.add_parser(name)
        if name == "ingest":
            c.add_argument("words", nargs="+")
        elif name == "merge":
            c.add_argument("out")
            c.add_argument("inputs", nargs="+")
        else:
            c.add_argument("file")
        if name in ("replay", "export"):
            c.add_argument("--from-ts")
            c.add_argument("--to-ts")
            c.add_argument("--data-only", "--data", action="store_true")
            c.add_argument("--limit", type=int, default=0)
            c.add_argument("--with-ts", action="store_true")
            c.add_argument("--human", action="store_true")
        if name == "index":
            c.add_argument("--every", type=int, default=16)
        if name == "repair":
            c.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from .operators import frames as O
    from .sources import decoders, inputs, segments

    if a.command == "verify":
        report = segments.verify_file(a.file)
        print(json.dumps(report))
        return report["exit_code"]
    if a.command == "repair":
        report = segments.repair_file(a.file, dry_run=a.dry_run)
        print(json.dumps(report))
        return report["exit_code"]
    if a.command == "index":
        entries, every = [], max(1, a.every)
        for row in segments.scan_file(a.file):
            if row[10] == 0 and row[1] % every == 0:
                entries.append((row[1], row[2], row[5], row[4]))
        fs, path = segments.open_fs(a.file)
        with fs.open_output_stream(path.removesuffix(".seg") + ".idx") as f:
            f.write(segments.index_bytes(entries, every, fs.get_file_info(path).size))
        print(json.dumps({"entries": len(entries), "every_n": every}))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "ingest":
        try:
            cfg = ingest_words(a.words)
        except ValueError as e:
            p.error(str(e))
        now = time.time_ns()
        data = inputs.open_source(spark, cfg["source"], cfg["detail"])
        text = data.select("path", decoders.F.decode("content", "UTF-8").alias("text"))
        fmt = cfg["format"] if cfg["format"] != "auto" else (data.select(decoders.sniff(decoders.F.col("content"))).first() or ["raw"])[0]
        rows = decoders.ndjson(text, now) if fmt in ("ndjson", "lines+json") else decoders.csv(text, now, "path") if fmt == "csv" else decoders.lines(text)
        w, n, last = segments.Writer(cfg["out"], now), 0, 0
        segments.control(w, 0, **segments.meta(fmt, cfg["label"], {"kind": cfg["source"], "detail": cfg["detail"]}, {"source": "now", "field": "", "parsed": ""}, cfg["rotate"], "soft"))
        segments.control(w, 1, run_id=str(now), start_ts=now)
        for r in rows.orderBy("path", "pos").toLocalIterator():  # one segment is one chain
            last = r["ts_ns"] if "ts_ns" in r else now
            w.append(segments_type(cfg["label"]), last, (r["record"] or "").encode())
            n += 1
        segments.control(w, 2, run_id=str(now), end_ts=last, status="CLEAN")
        w.close(records=n)
        return 0
    if a.command == "merge":
        w = segments.Writer(a.out, time.time_ns())
        firsts = []
        for k, uri in enumerate(a.inputs):
            if segments.verify_file(uri)["exit_code"] > 1:
                print(f"damaged: {uri}", file=sys.stderr)
                return 2
            first = next((r[5] for r in segments.scan_file(uri) if r[10] == 0 and r[4] < segments.CONTROL_TYPE), None)
            firsts.append((first is None, first or 0, k, uri))
        for *_, uri in sorted(firsts):
            for r in segments.scan_file(uri):
                if r[10] == 0:
                    w.append(r[4], r[5], r[7])
        w.close()
        return 0
    frames = segments.scan(spark, a.file).withColumn("payload", O.F.decode("payload", "UTF-8"))
    if a.command == "info":
        print(json.dumps(O.info(frames, ("path",)).first().asDict()))
        return 0
    got = O.replay(frames, a.from_ts, a.to_ts, a.data_only, a.limit, ("path", "frame_index")).orderBy("path", "frame_index")
    if a.command == "export":
        got = O.export(got)
    elif a.human:
        got = O.human_rows(got)
    for r in got.toLocalIterator():
        print(r["line"] if a.command == "export" else "  ".join(map(str, r)) if a.human else f"{r['ts_ns']} {r['payload']}" if a.with_ts else r["payload"])
    return 0


def segments_type(label: str) -> int:
    from .functions.scalars import fnv1a_of

    return fnv1a_of(label)


if __name__ == "__main__":
    sys.exit(main())
