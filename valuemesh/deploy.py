"""Getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application once, so that workers can import it wherever the
    driver found it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="valuemesh-"), "valuemesh.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, folders, files in os.walk(root):
            folders[:] = sorted(d for d in folders if d != "__pycache__")
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("valuemesh", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
