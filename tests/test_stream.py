"""Streaming ingest: first run, restart, replayed batch, removed checkpoint."""

import glob
import os

from filetree import write_files
from fleetlake.sinks.table import read_audit, read_table
from fleetlake.streaming.ingest_stream import run_available_now

HEADER = "timestamp,speed,odometer,soc,elevation,shift_state"


def _file(day, n, bad_row=None):
    rows = []
    for i in range(n):
        soc = "150" if i == bad_row else "50"
        rows.append(f"2026-07-{day:02d}T10:{i:02d}:00Z,{i},{1000 + i},{soc},1,D")
    return HEADER + "\n" + "\n".join(rows) + "\n"


def _keys(spark, table):
    return sorted((r["vehicle_id"], r["timestamp"]) for r in read_table(spark, table).collect())


def test_restart_replay_and_new_checkpoint(spark, tmp_dir):
    inbox, table, audit, ckpt = (f"{tmp_dir}/{x}" for x in ("in", "table", "audit", "ckpt"))
    os.makedirs(inbox)
    write_files(inbox, {"car-1.csv": _file(1, 10, bad_row=3), "car-2.csv": _file(1, 5)})
    logs = []
    run_available_now(spark, inbox, table, ckpt, audit_path=audit, max_files_per_trigger=1, log=logs.append)
    assert len(_keys(spark, table)) == 14
    assert len(logs) == 2 and all(line.startswith("batch=") for line in logs)
    ingest_ids = {r["ingest_id"] for r in read_audit(spark, audit).collect()}
    assert len(ingest_ids) == 2 and all(i.rsplit("-", 1)[1].isdigit() for i in ingest_ids)

    # Restart after a new file arrives: only the new file is read.
    write_files(inbox, {"car-3.csv": _file(2, 4)})
    logs.clear()
    run_available_now(spark, inbox, table, ckpt, audit_path=audit, log=logs.append)
    assert len(logs) == 1 and "read=4" in logs[0]
    assert len(_keys(spark, table)) == 18

    # Crash between write and commit: the last batch runs again, same rows and ids.
    before = sorted(tuple(r) for r in read_table(spark, table).collect())
    commits = sorted(glob.glob(f"{ckpt}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(commits[-1])
    crc = os.path.join(os.path.dirname(commits[-1]), f".{os.path.basename(commits[-1])}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    logs.clear()
    run_available_now(spark, inbox, table, ckpt, audit_path=audit, log=logs.append)
    assert len(logs) == 1
    assert sorted(tuple(r) for r in read_table(spark, table).collect()) == before

    # A new checkpoint re-reads everything; the anti join skips what is stored.
    logs.clear()
    run_available_now(spark, inbox, table, f"{ckpt}-new", audit_path=audit, log=logs.append)
    assert all("inserted=0" in line for line in logs)
    assert sorted(tuple(r) for r in read_table(spark, table).collect()) == before
    ids = sorted(r["id"] for r in read_table(spark, table).collect())
    assert len(ids) == len(set(ids)) == 18


def test_query_id_fallback_reads_the_checkpoint(spark, tmp_dir):
    import json

    from fleetlake.streaming.ingest_stream import _query_id

    inbox, table, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/table", f"{tmp_dir}/ckpt"
    os.makedirs(inbox)
    write_files(inbox, {"car-1.csv": _file(1, 3)})
    run_available_now(spark, inbox, table, ckpt, log=lambda _m: None)
    with open(f"{ckpt}/metadata") as fh:
        expected = json.loads(fh.readline())["id"]
    # Outside a micro-batch the local property is unset: the id comes from the checkpoint.
    assert _query_id(spark, ckpt) == expected
