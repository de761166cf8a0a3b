"""Stages that restart: each result is kept under a fingerprint of all it comes from."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """A named step: build(inputs..., **settings) gives its table from the tables of the stages or sources named in inputs."""

    name: str
    build: Callable[..., DataFrame]
    inputs: Sequence[str] = ()
    settings: Mapping[str, object] = field(default_factory=dict)


def source_mark(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of every file of a table that Spark reads: changed input has another mark."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marks = []
    for name in sorted(spark.read.format("binaryFile").load(path).inputFiles()):
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        status = place.getFileSystem(conf).getFileStatus(place)
        marks.append((name, status.getLen(), status.getModificationTime()))
    return marks


def code_mark(build: Callable[..., DataFrame]) -> str:
    try:
        return inspect.getsource(build)
    except (OSError, TypeError):
        return getattr(build, "__qualname__", repr(build))


def run_stages(spark: SparkSession, folder: str, stages: Sequence[Stage], sources: Mapping[str, str], wanted: Sequence[str] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """Tables of the wanted stages (all by default), and the names of the stages that ran.

    sources: name -> path of a Parquet table. A stage's fingerprint covers its own code and
    settings and the fingerprints of its inputs, down to the files of the sources; its
    table stands in folder/name/fingerprint. A complete one (Spark's _SUCCESS is its
    done-mark) is read, anything else is built and written anew, so a run that died goes on where
    it was, and a change runs what depends on it and nothing else. Code that a stage
    calls is not covered: put a version into its settings.
    """
    known = {name: "source" for name in sources}
    for s in stages:
        if s.name in known:
            raise ValueError(f"{s.name} is there twice")
        if missing := [i for i in s.inputs if i not in known]:
            raise ValueError(f"{s.name} needs {missing} before it")
        known[s.name] = "stage"
    need, todo = set(), list(wanted if wanted is not None else [s.name for s in stages])
    by_name = {s.name: s for s in stages}
    while todo:
        if (name := todo.pop()) not in need and name in by_name:
            need.add(name)
            todo += by_name[name].inputs
    marks, tables, ran = {}, {}, []
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, default=str).encode()).hexdigest()
    for name in {i for s in stages if s.name in need for i in s.inputs if i in sources}:
        marks[name], tables[name] = digest(source_mark(spark, sources[name])), spark.read.parquet(sources[name])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for s in stages:
        if s.name not in need:
            continue
        marks[s.name] = digest([s.name, code_mark(s.build), dict(s.settings), [marks[i] for i in s.inputs]])
        path = f"{folder}/{s.name}/{marks[s.name]}"
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            s.build(*[tables[i] for i in s.inputs], **s.settings).write.mode("overwrite").parquet(path)
            ran.append(s.name)
        tables[s.name] = spark.read.parquet(path)
    return {name: tables[name] for name in (wanted if wanted is not None else by_name)}, ran
