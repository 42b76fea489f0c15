"""Code for the Python workers of a session.

Executors of a cluster need not see the driver's folders, so the package's
source is added to the job once per session (``addPyFile``: the driver
serves it and every executor, a replaced one too, fetches its own copy).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python workers (once)."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if os.path.isdir(top):          # else the package already came in an archive
            target = os.path.join(tempfile.mkdtemp(prefix="preflight-code-"), "preflight_code.zip")
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
                for folder, _, names in os.walk(top):
                    for n in sorted(names):
                        if n.endswith(".py"):
                            p = os.path.join(folder, n)
                            z.write(p, os.path.relpath(p, os.path.dirname(top)))
            sc.addPyFile(target)
        _SHIPPED.add(sc.applicationId)
    return spark
