"""``FrameCoder.java`` as expressions over frames, compiled by the Java compiler that is part of Spark (Janino)."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _array(spark: SparkSession, kind, value) -> JavaObject:
    out = spark.sparkContext._gateway.new_array(kind, 1)
    out[0] = value
    return out


#: The class's two functions for each application, whose sessions share them: a jar of one name can be sent once.
_MADE: dict[str, dict[str, JavaObject]] = {}


def _instances(spark: SparkSession) -> dict[str, JavaObject]:
    """Both functions; the application's executors get the class as a jar."""
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = _make(spark)
    return _MADE[app]


def _make(spark: SparkSession) -> dict[str, JavaObject]:
    jvm = spark.sparkContext._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(spark._jsparkSession.getClass().getClassLoader())
    compiler.cook(Path(__file__).with_name("FrameCoder.java").read_text())
    jar = Path(tempfile.mkdtemp(prefix="tessella-")) / "frame-coder.jar"
    with zipfile.ZipFile(jar, "w", zipfile.ZIP_DEFLATED) as z:
        for entry in compiler.getBytecodes().entrySet():
            z.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
    spark.sparkContext._jsc.addJar(str(jar))
    made = compiler.getClassLoader().loadClass("tessella.FrameCoder").getConstructor(_array(spark, jvm.java.lang.Class, jvm.java.lang.Boolean.TYPE))
    return {name: made.newInstance(_array(spark, jvm.java.lang.Object, back)) for name, back in (("tessella_coded", False), ("tessella_plain", True))}


def _call(spark: SparkSession, name: str, frame: str) -> Column:
    function = _instances(spark)[name]
    spark._jsparkSession.udf().register(name, function, spark.sparkContext._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return F.call_udf(name, F.col(frame))


def coded(spark: SparkSession, frame: str) -> Column:
    """Plain frames, coded."""
    return _call(spark, "tessella_coded", frame)


def plain(spark: SparkSession, frame: str) -> Column:
    """Coded frames, plain; damage is an error."""
    return _call(spark, "tessella_plain", frame)
