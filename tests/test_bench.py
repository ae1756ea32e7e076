import json
import subprocess
import sys
from pathlib import Path


def test_bench_times_every_query(tmp_path):
    (tmp_path / "__spark_entry__.py").write_text("def queries():\n    return {n: lambda spark, path: spark.range(1) for n in ('duplicate_content', 'op5_sharding', 'pipeline')}\n")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {str(Path(__file__).parents[1])!r}]; import bench; bench.main()"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=100, cwd=tmp_path, check=True).stdout
    assert set(json.loads(out.splitlines()[-1])["queries"]) == {"duplicate_content", "op5_sharding", "pipeline"}
