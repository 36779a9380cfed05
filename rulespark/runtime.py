"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that they need no installation."""
    context = spark.sparkContext
    if getattr(context, "_rulespark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="rulespark-")) / "rulespark_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(target))
    context._rulespark_shipped = True
