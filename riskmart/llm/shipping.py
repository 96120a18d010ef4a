"""The package for the executors' Python."""

from __future__ import annotations

import io
import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = pathlib.Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the workers, once per application, as --py-files would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, str(path.relative_to(PACKAGE.parent)))
    folder = pathlib.Path(tempfile.mkdtemp(prefix=f"{PACKAGE.name}-"))
    target = folder / f"{PACKAGE.name}-llm.zip"
    target.write_bytes(body.getvalue())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
