"""The package itself for executors that have not installed it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to Python workers, once per application.

    The driver serves them as one small archive, so jobs need no ``--py-files``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # imported from an archive: whoever sent that has seen to it
        return
    folder = tempfile.mkdtemp(prefix="tessera-")
    path = os.path.join(folder, "tessera_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
