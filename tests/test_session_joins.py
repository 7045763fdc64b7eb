"""Shared folder lookup and the bounded broadcast helper."""

import contextlib
import io

from pkgpulse.session import shared_dir


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_shared_dir_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert current.startswith(configured.rstrip("/"))
