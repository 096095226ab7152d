"""Summarise stage times from a Spark event log written by ``BENCH_EVENT_LOG=<dir> python bench.py``.

    python tests/stage_times.py <dir> [top_n]
"""

import glob
import io
import json
import sys

import zstandard


def stage_times(log_dir: str) -> dict[int, tuple[str, int, int]]:
    stages = {}
    for f in glob.glob(f"{log_dir}/**/events_*", recursive=True):
        with open(f, "rb") as fh:
            raw = zstandard.ZstdDecompressor().stream_reader(fh) if f.endswith(".zstd") else fh
            for line in io.TextIOWrapper(raw, errors="ignore"):
                try:
                    e = json.loads(line)
                except ValueError:
                    continue
                if isinstance(e, dict) and e.get("Event") == "SparkListenerStageCompleted":
                    i = e["Stage Info"]
                    stages[i["Stage ID"]] = (i["Stage Name"], i["Number of Tasks"],
                                             i["Completion Time"] - i["Submission Time"])
    return stages


if __name__ == "__main__":
    s = stage_times(sys.argv[1])
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    print(f"{len(s)} stages, {sum(v[2] for v in s.values())} ms")
    for sid, (name, tasks, ms) in sorted(s.items(), key=lambda x: -x[1][2])[:top]:
        print(f"stage {sid:5d} tasks {tasks:5d} {ms:7d} ms  {name[:60]}")
