"""JARs parsed once, by content; broken and absent ones."""

import glob
import os
import shutil
import zipfile

import pyspark
import pytest

from codeloom.sources import dependency_index as d

JAR = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "slf4j-api-*.jar")))[0]


@pytest.fixture
def folders(tmp_path):
    os.makedirs(tmp_path / "lib")
    shutil.copy(JAR, tmp_path / "lib" / "a.jar")
    with zipfile.ZipFile(JAR) as whole, zipfile.ZipFile(tmp_path / "lib" / "b.jar", "w") as some:
        for name in [n for n in whole.namelist() if n.endswith(".class")][:3]:
            some.writestr(name, whole.read(name))
        some.writestr("x/Broken.class", b"\xca\xfe\xba\xbe\0\0")
    with zipfile.ZipFile(tmp_path / "lib" / "none.jar", "w") as empty:
        empty.writestr("readme.txt", "no classes")
    return tmp_path / "lib", str(tmp_path / "store")


def files(spark, lib):
    return spark.read.format("binaryFile").load(str(lib)).selectExpr("element_at(split(path, '/'), -1) AS path", "content")


def test_only_unknown_jars_are_parsed(spark, folders):
    lib, store = folders
    one = d.update(files(spark, lib), store, ["b.jar", "a.jar", "none.jar", "gone.jar"])
    told = {r.jar: (r.status, r.classes, r.problems) for r in one.status.collect()}
    assert one.parsed == 3 and told["a.jar"][0] == told["none.jar"][0] == "COMPLETE" and told["a.jar"][1] > 20 and told["none.jar"][1:] == (0, 0)
    assert told["b.jar"] == ("DEGRADED", 3, 1) and told["gone.jar"] == ("UNAVAILABLE", 0, 0) and one.overall() == "DEGRADED"
    again = d.update(files(spark, lib), store, ["a.jar", "none.jar"])
    assert again.parsed == 0 and again.overall() == "COMPLETE" and again.classes.count() == told["a.jar"][1]
    # the same content by another name is known; a changed JAR isn't
    shutil.copy(lib / "a.jar", lib / "c.jar")
    with zipfile.ZipFile(lib / "none.jar", "a") as more:
        more.writestr("other.txt", "x")
    third = d.update(files(spark, lib), store, ["c.jar", "b.jar", "none.jar"])
    assert third.parsed == 1 and third.classes.where("jar = 'c.jar'").count() == told["a.jar"][1]
    # of a class in several JARs the first on the class path counts
    first = {r.class_name: r.jar for r in third.first().collect()}
    assert set(first.values()) == {"c.jar"} and {r.jar for r in one.first().collect()} == {"a.jar", "b.jar"}


def test_what_a_lost_run_left_is_parsed_again(spark, folders):
    lib, store = folders
    d.update(files(spark, lib), store)
    shutil.rmtree(os.path.join(store, "manifest"))
    again = d.update(files(spark, lib), store, ["a.jar"])
    assert again.parsed == 1 and again.classes.groupBy("class_name").count().where("count > 1").isEmpty()


def test_no_jars(spark, tmp_path):
    none = spark.createDataFrame([], "path string, content binary")
    index = d.update(none, str(tmp_path / "s"), ["x.jar"])
    assert index.parsed == 0 and index.overall() == "UNAVAILABLE" and index.classes.isEmpty() and index.first().isEmpty()
    assert d.update(none, str(tmp_path / "s")).overall() == "COMPLETE"


def test_details_of_external_types(spark, folders):
    lib, store = folders
    index = d.update(files(spark, lib), store, ["a.jar"])
    row = d.type_details(index, "NOPLogger").first()
    assert row.class_name == "org.slf4j.helpers.NOPLogger" and row.kind == "CLASS" and row.jar == "a.jar" and set(row.supertypes[:2]) == {"org.slf4j.helpers.NamedLoggerBase", "org.slf4j.Logger"}
    assert d.type_details(index, "org.slf4j.Logger").first().kind == "INTERFACE" and d.type_details(index, "Nothing").isEmpty()
    own = {(r.name, r.descriptor) for r in d.type_members(index, "NOPLogger").collect()}
    whole = {(r.name, r.descriptor): r.owner for r in d.type_members(index, "NOPLogger", inherited=True).collect()}
    assert ("isInfoEnabled", "()Z") in own and own < set(whole) and whole["isInfoEnabled", "()Z"] == "org.slf4j.helpers.NOPLogger"
    assert whole["isInfoEnabled", "(Lorg/slf4j/Marker;)Z"] == "org.slf4j.helpers.NOPLogger" and "org.slf4j.helpers.NamedLoggerBase" in whole.values()
