"""The package reaches workers that do not start in the repository."""

import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_shipped_package_is_importable_by_workers(tmp_path):
    script = textwrap.dedent(
        f"""
        import sys
        sys.path.insert(0, {str(ROOT)!r})
        from ratewise.session import local_session, ship
        spark = local_session("ship", 2, "1g", **{{"spark.checkpoint.dir": "{tmp_path}/shared"}})
        address = ship(spark)
        assert ship(spark) == address and address.endswith("ratewise.zip")

        def where(batches):
            import ratewise.contracts
            for b in batches:
                yield b.assign(at=ratewise.contracts.__file__)

        rows = spark.range(2).mapInPandas(where, "id long, at string").collect()
        assert all("ratewise.zip" in r["at"] for r in rows), rows
        spark.stop()
        """
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
