"""Project structures: templates, listings and the writer."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternmill.functions.replies import structure_of

STRUCTURE = "name string, directories array<string>, files map<string,string>"

# Contents of generated files are fixed values; {name}, {about} and {package} are filled in.
_README = "# {name}\n\n{about}\n"
_SETUP = 'from setuptools import setup, find_packages\n\nsetup(\n    name="{name}",\n    version="0.1.0",\n    packages=find_packages(where="src"),\n    package_dir={{"": "src"}},\n)\n'
_PY_MAIN = '"""Main entry point for {name}."""\n\ndef main():\n    print("Hello from {name}!")\n\nif __name__ == "__main__":\n    main()\n'
_PY_TEST = '"""Tests for main module."""\n\ndef test_placeholder():\n    assert True\n'
_API_MAIN = '"""FastAPI application."""\n\nfrom fastapi import FastAPI\n\napp = FastAPI()\n\n@app.get("/")\ndef read_root():\n    return {{"message": "Hello World"}}\n\n@app.get("/health")\ndef health_check():\n    return {{"status": "healthy"}}\n'
_JS_MAIN = '// Main entry point for {name}\n\nconsole.log("Hello from {name}!");\n'
_POM = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<project>\n    <modelVersion>4.0.0</modelVersion>\n    <groupId>com.{package}</groupId>\n'
    "    <artifactId>{name}</artifactId>\n    <version>0.1.0</version>\n</project>\n"
)
_JAVA_MAIN = 'package com.{package};\n\npublic class Application {{\n    public static void main(String[] args) {{\n        System.out.println("Hello from {name}!");\n    }}\n}}\n'


def _node_package(name: str) -> str:
    return json.dumps({"name": name, "version": "0.1.0", "main": "src/index.js", "scripts": {"start": "node src/index.js", "test": "jest"}}, indent=2, ensure_ascii=False) + "\n"


def family(stack: list[str]) -> str:
    """Which template a stack gets: python before node before java."""
    known = {s.lower() for s in stack}
    if "python" in known:
        return "python"
    if known & {"typescript", "javascript", "node"}:
        return "node"
    return "java" if "java" in known else "generic"


def template(name: str, kind: str, stack: list[str]) -> tuple[list[str], dict[str, str]]:
    """Folders and files of a new project."""
    package = name.replace("-", "").lower()
    fill = lambda text: text.format(name=name, about=f"{kind.title()} built with {', '.join(stack)}", package=package)
    files = {"README.md": fill(_README)}
    which = family(stack)
    if which == "python":
        api = "fastapi" in {s.lower() for s in stack}
        files |= {
            "requirements.txt": "fastapi>=0.100.0\nuvicorn>=0.23.0\n" if api else "# Project dependencies\n",
            "setup.py": fill(_SETUP),
            "src/__init__.py": "",
            "src/main.py": fill(_API_MAIN if api else _PY_MAIN),
            "tests/__init__.py": "",
            "tests/test_main.py": _PY_TEST,
        }
        return ["src", "tests", "docs"], files
    if which == "node":
        return ["src", "tests"], files | {"package.json": _node_package(name), "src/index.js": fill(_JS_MAIN)}
    if which == "java":
        home = f"src/main/java/com/{package}"
        return ["src/main/java", "src/main/resources", "src/test/java", home], files | {"pom.xml": fill(_POM), f"{home}/Application.java": fill(_JAVA_MAIN)}
    return ["src", "docs", "tests"], files


PROMPT = (
    "Plan a new project.\nName: {name}\nKind: {kind}\nStack: {stack}\n\nPatterns to follow:\n\n{patterns}\n"
    'Reply with one JSON object and nothing else: {{"directories": [paths], "files": {{path: content}}}}.'
)


def filled(prompt: str, name: str, kind: str, stack: list[str], patterns: list[str]) -> str:
    """The prompt with its fields filled in; without patterns it says that there are none."""
    return prompt.format(name=name, kind=kind, stack=", ".join(stack), patterns="\n".join(patterns) or "None yet.")


def scaffold(spark: SparkSession, name: str, kind: str, stack: str | list[str]) -> DataFrame:
    """One row with the structure of a new project."""
    split = [s.strip() for s in stack.split(",")] if isinstance(stack, str) else stack
    folders, files = template(name, kind, split)
    return spark.createDataFrame([(name, folders, files)], STRUCTURE)


def scaffolds(projects: DataFrame) -> DataFrame:
    """The structures (STRUCTURE) of many projects (name, kind, stack as an array), made where the rows are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [template(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            folders, files = pa.array([m[0] for m in made], pa.list_(pa.string())), pa.array([list(m[1].items()) for m in made], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), folders, files], names=["name", "directories", "files"])

    return projects.select("name", "kind", "stack").mapInArrow(run, STRUCTURE)


def structure_from(spark: SparkSession, name: str, kind: str, stack: list[str], ask: Callable[[str], str] | None = None, prompt: str = "") -> DataFrame:
    """The structure that a model's reply gives, or the template without a model or if asking fails.

    A reply that cannot be parsed is no failure to ask: it raises ValueError.
    """
    reply = None
    if ask is not None:
        try:
            reply = ask(prompt)
        except Exception:  # noqa: BLE001  any failure of the model leaves the template
            ask = None
    if ask is None:
        return scaffold(spark, name, kind, stack)
    row = spark.createDataFrame([(reply,)], "reply string").select(structure_of(F.col("reply")).alias("s")).first()["s"]
    if row is None:
        raise ValueError("the reply is no structure")
    return spark.createDataFrame([(name, row["directories"], row["files"])], STRUCTURE)


def listing(structures: DataFrame) -> DataFrame:
    """(name, kind, path) of folders and files in code point order, with position."""
    folders = structures.select("name", F.lit("directory").alias("kind"), F.posexplode(F.array_sort("directories")).alias("position", "path"))
    files = structures.select("name", F.lit("file").alias("kind"), F.posexplode(F.array_sort(F.map_keys("files"))).alias("position", "path"))
    return folders.unionByName(files)


def write_project(structure: DataFrame, folder: str) -> str:
    """Write the one project to a folder of this machine; a path that leads out of it is refused before anything is written."""
    row = structure.first()
    root = os.path.realpath(os.path.join(folder, row["name"]))
    within = lambda p: os.path.realpath(os.path.join(root, p))
    if not root.startswith(os.path.realpath(folder) + os.sep):
        raise ValueError(f"{row['name']} leads out of the folder")
    for p in [*row["directories"], *row["files"]]:
        if os.path.isabs(p) or not (within(p) + os.sep).startswith(root + os.sep):
            raise ValueError(f"{p} leads out of the project")
    for p in row["directories"]:
        os.makedirs(within(p), exist_ok=True)
    for p, text in row["files"].items():
        os.makedirs(os.path.dirname(within(p)), exist_ok=True)
        with open(within(p), "w", encoding="utf-8") as f:
            f.write(text)
    return root
