"""Trees, logs and graphs derived from the given tables.

Each view is one SQL text that both Spark and the checking engine run, so the
checked queries start from the same rows.  ``@table`` stands for a given table
and ``@OCTETS`` for the function that counts bytes of a text.  All of them read
whole tables and whole texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"

# One file per document, three levels deep; the repo is the document's source.
FILES = """
SELECT source AS repo, 'head' AS snapshot,
  lang || '/' || cast(doc_id % 7 AS string) || '/doc_' || cast(doc_id AS string) ||
  CASE doc_id % 9 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.html'
    WHEN 3 THEN '.json' WHEN 4 THEN '' ELSE '.txt' END AS path,
  cast(@OCTETS(text) AS bigint) AS size,
  cast(1700000000 - (doc_id * 7919) % 50000000 AS double) AS mtime,
  text
FROM @documents
"""

# A second snapshot: some files gone, some changed in size, some in content only.
FILES_B = f"""
SELECT repo, 'next' AS snapshot, path, cast(@OCTETS(text) AS bigint) AS size, mtime, text FROM (
  SELECT repo, path, mtime,
    CASE WHEN size % 11 = 0 THEN text || ' changed'
         WHEN size % 7 = 0 THEN replace(text, ' ', '_') ELSE text END AS text
  FROM ({FILES}) a WHERE size % 13 <> 0
  UNION ALL
  SELECT source, 'new/n' || cast(doc_id AS string) || '.txt', 0.0, text FROM @documents WHERE n_chars % 17 = 0
) b
"""

# Names of every kind: hidden, ignored, secret, tests, entry points, odd cases.
TREE = """
SELECT source AS repo, 'head' AS snapshot,
  lang || '/' || CASE doc_id % 11 WHEN 0 THEN '.cache/' WHEN 1 THEN 'build/' WHEN 2 THEN 'tests/' ELSE '' END
  || 'd' || cast(doc_id % 7 AS string) || '/' ||
  CASE doc_id % 13
    WHEN 0 THEN 'p' || cast(doc_id AS string) || '/main.py'
    WHEN 1 THEN 'p' || cast(doc_id AS string) || '/Package.json'
    WHEN 2 THEN '.env.' || cast(doc_id AS string)
    WHEN 3 THEN 'id_rsa_' || cast(doc_id AS string)
    WHEN 4 THEN 'Secret_' || cast(doc_id AS string) || '.TXT'
    WHEN 5 THEN 'test_' || cast(doc_id - 1 AS string) || '.py'
    WHEN 6 THEN cast(doc_id - 2 AS string) || '.py'
    WHEN 7 THEN 'a.tar.' || cast(doc_id AS string) || '.gz'
    WHEN 8 THEN 'Doc_' || cast(doc_id AS string) || '.md'
    WHEN 9 THEN 'p' || cast(doc_id AS string) || '/Makefile'
    WHEN 10 THEN 'log_' || cast(doc_id AS string) || '.log'
    WHEN 11 THEN 'x' || cast(doc_id AS string) || '.spec.ts'
    ELSE 'Ä_' || cast(doc_id AS string) || 'ß.txt' END AS path,
  cast(@OCTETS(text) AS bigint) AS size,
  cast(1700000000 - (doc_id * 7919) % 50000000 AS double) AS mtime,
  cast(1700000000 - (doc_id * 104729) % 90000000 AS double) AS ctime,
  cast(32768 + (doc_id * 37) % 4096 AS int) AS mode,
  doc_id % 50 = 0 AS denied,
  text
FROM @documents
"""

# Ignore rules of the roots and of two kinds of inner directories.
RULES = """
SELECT DISTINCT repo, 'head' AS snapshot,
  CASE WHEN n <= 5 THEN '' WHEN n <= 7 THEN 'en' ELSE lang || '/d6' END AS dir,
  CASE WHEN n <= 5 THEN n WHEN n <= 7 THEN n - 5 ELSE 1 END AS line_no,
  CASE n WHEN 1 THEN '*.log' WHEN 2 THEN '!log_?[0-4]*.log' WHEN 3 THEN 'build/'
    WHEN 4 THEN '/fr/d[1-3]/' WHEN 5 THEN 'Doc_*' WHEN 6 THEN '/d5'
    WHEN 7 THEN '!Doc_*[!02468].md' ELSE 'a.tar*' END AS pattern
FROM (SELECT source AS repo, lang, @EXPLODE(1, 8) AS n FROM (SELECT DISTINCT source, lang FROM @documents) d) r
"""

# A commit per event, newest first by time, touching one or two paths.
COMMITS = """
SELECT 'events' AS repo, ts, event_id, substring(md5(cast(event_id AS string)), 1, 7) AS hash,
  'd' || cast(event_id % 400 AS string) AS date, 'u' || cast(user_id AS string) AS author,
  event_type || ' ' || props || ' by u' || cast(user_id AS string) || ' and a longer story' AS subject
FROM @events
"""

COMMIT_FILES = """
SELECT 'events' AS repo, event_id, event_type || '/u' || cast(user_id % 20 AS string) AS path FROM @events
UNION ALL
SELECT 'events', event_id, 'all/' || event_type FROM @events WHERE value > 20
"""

# Import edges: many repos of 40 files each, denser for some.
EDGES = """
SELECT DISTINCT repo, 'head' AS snapshot, src, dst FROM (
  SELECT 'r' || cast(cast(floor(o_orderkey / 60) AS bigint) AS string) AS repo,
    'lib/f' || cast(o_custkey % 40 AS string) AS src,
    'lib/f' || cast((o_orderkey * 7 + o_custkey) % 40 AS string) AS dst
  FROM @orders) e
WHERE src <> dst
"""

PAGES = """
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo, 'head' AS snapshot,
  'p' || cast(page_id AS string) || '.html' AS path, html AS text
FROM @pages
"""

TURNS = """
SELECT cast(conv_id AS string) AS repo, 'head' AS snapshot, turn AS pos, role || ': ' || text AS text
FROM @conversations
"""


def _code(*lines: str) -> str:
    """SQL for a text of lines; ``{k}``, ``{k+12}`` ... are the file's numbers."""

    def literal(line: str) -> str:
        parts = re.split(r"(\{[^}]*\}|\\)", line)
        out = []
        for p in parts:
            if p == "\\":
                out.append("chr(92)")
            elif p.startswith("{") and p.endswith("}") and re.fullmatch(r"\{[kj0-9+%()-]+\}", p):
                out.append(f"cast({p[1:-1]} AS string)")
            elif p == "{repo}":
                out.append("source")
            elif p:
                out.append("'" + p.replace("'", "''") + "'")
        return " || ".join(out) if out else "''"

    return (f" || {NL} || ").join(literal(line) for line in lines) + f" || {NL}"


def _comment(mark: str) -> str:
    return f"'{mark} ' || replace(text, {NL}, {NL} || '{mark} ') || {NL}"


# Source files of twelve kinds; every body carries the whole document as comments.
_KINDS = [
    (
        "'pkg/m' || k || '.py'",
        _code("import os, sys as system", "from . import m{k+12}, nothing", "from .sub1 import m{k+1}",
              "import pkg.m{k-12}") + " || " + _comment("#") + " || " +
        _code("class Box{k}(object):", '    """Holds one thing.', "", '    More."""', "    def get(self, a=(1, 2)):",
              "        return a", "    def _set(self):", "        pass", "async def load_{k}(x,", "         y=2):",
              "    def local():", "        pass", "    return x"),
    ),
    (
        "'pkg/sub' || (k % 3) || '/m' || k || '.py'",
        _code("from ..m{k-1} import Box", "from pkg.m{k+11} import (", "    Box,", "    other as thing,", ")") +
        " || " + _comment("#") + " || " + _code("def _hidden{k}(x):", "    return x") +
        f" || CASE WHEN k % 24 = 1 THEN 'def broken(:' || {NL} ELSE '' END",
    ),
    (
        "'web/m' || k || '.js'",
        _code("import { a, b } from './ui/m{k+1}';", "export * from './m{k+12}.js';", 'const fs = require("fs");',
              "const lazy = import('../web/ui/m{k+1}');", "import React from 'react';", "import lib from '@lib/m{k+1}';",
              "const h = require('#ui/m{k+1}');") + " || " + _comment("//") + " || " +
        _code("export default class View{k} {", "  render() { return null; }", "}", "export const make{k} = async (x) => {",
              "  return x;", "};", "function hidden{k}(a) {", "  if (a) {", "    return a;", "  }", "}"),
    ),
    (
        "'web/ui/m' || k || '.ts'",
        _code("import x from '../m{k-1}';", "import y from '.';", "import z from 'web/ui/m{k+12}';") + " || " +
        _comment("//") + " || " + _code("export function helper{k}(): number {", "  return 1;", "}",
                                        "const local{k} = (b: number) => b - 1;"),
    ),
    (
        "'svc/p' || (j % 4) || '/m' || k || '.go'",
        _code("package p", "", "import (", '\t"fmt"', '\t"example.org/{repo}/svc/p{(j+1)%4}"', ")", 'import "strings"') +
        " || " + _comment("//") + " || " +
        _code("type Shape{k} struct {", "\tN int", "}", "type doer{k} interface {", "\tDo() error", "}",
              "func (s *Shape{k}) Area(x int) int {", "\treturn x", "}", "func inner{k}() {}"),
    ),
    (
        "'src/m' || k || '.rs'",
        _code("mod m{k+12};", "mod n{k};", "use crate::m{k+12}::Thing;", "use std::{fmt, io::Read};",
              "use super::m{k-12}::{Thing as T, helper};") + " || " + _comment("//") + " || " +
        _code("pub struct Thing{k} {", "    a: u8,", "}", "impl Thing{k} {", "    pub fn new() -> Self {",
              "        Thing{k} { a: 1 }", "    }", "}", "pub trait Run{k} {", "    fn go(&self);", "}", "fn alone{k}() {}") +
        f" || CASE WHEN k % 24 = 5 THEN '#[cfg(test)]' || {NL} ELSE '' END",
    ),
    (
        "'java/org/acme/C' || k || '.java'",
        _code("package org.acme;", "import org.acme.C{k+12};", "import org.acme.K{k+3};", "import java.util.List;",
              "import C{k};") + " || " + _comment("//") + " || " +
        _code("public class C{k} {", "    private int size(int a) {", "        return a;", "    }",
              "    public String name() {", '        return "x";', "    }", "}"),
    ),
    (
        "'php/Lib/P' || k || '.php'",
        _code("<?php", "use Lib\\P{k+12};", "use Vendor\\Thing;", "require_once 'P{k-12}.php';", "include('../shared.php');") +
        " || " + _comment("//") + " || " +
        _code("class P{k} {", "    private function hide() {", "    }", "    public function show($a) {", "    }", "}"),
    ),
    (
        "'rb/m' || k || '.rb'",
        _code("require 'json'", "require_relative 'm{k+12}'") + " || " + _comment("#") + " || " +
        _code("module Mod{k}", "  class Thing", "    def run!", "    end", "    def self._skip", "    end", "  end", "end"),
    ),
    (
        "'kt/org/acme/K' || k || '.kt'",
        _code("import org.acme.C{k-3}", "import kotlin.math.abs") + " || " + _comment("//") + " || " +
        _code("data class K{k}(val a: Int) {", "    private fun hide() {", "    }", "    fun show(x: Int): Int {",
              "        return x", "    }", "}"),
    ),
    (
        "'tests/test_m' || (k - 10) || '.py'",
        _code("from pkg.m{k-10} import Box") + " || " + _comment("#") + " || " + _code("def test_it():", "    assert True"),
    ),
    (
        "'native/m' || k || '.c'",
        _code('#include "x.h"') + " || " + _comment("//") + " || " +
        _code("static int add{k}(int a,", "               int b)", "{", "    return a + b;", "}", "struct point {", "    int x;", "};"),
    ),
]

_MANIFESTS = [
    ("go.mod", _code("// module of the tree", "module example.org/{repo}", "go 1.22")),
    (
        "package.json",
        _code('{"name": "x", "main": "web/m2.js", "bin": {"x": "./web/ui/m3.ts", "y": "nope.js"},',
              ' "imports": {"#ui/*": "./web/ui/*.ts", "#o": {"node": "x"}}}'),
    ),
    (
        "tsconfig.json",
        _code("{", "  // aliases", '  "compilerOptions": {', '    "baseUrl": ".", /* root */',
              '    "paths": {"@lib/*": ["nope/*", "web/ui/*"],},', "  },", "}"),
    ),
    ("Cargo.toml", _code("[package]", 'name = "{repo}"')),
    (".gitignore", _code("# build output", "", "  *.o  ", "/out/", "!keep.o")),
]

CODE = (
    "SELECT repo, 'head' AS snapshot, path, text, cast(@OCTETS(text) AS bigint) AS size FROM (\n"
    "SELECT source AS repo, CASE k % 12 "
    + " ".join(f"WHEN {i} THEN {path}" for i, (path, _) in enumerate(_KINDS))
    + " END AS path, CASE k % 12 "
    + " ".join(f"WHEN {i} THEN {text}" for i, (_, text) in enumerate(_KINDS))
    + " END AS text FROM (SELECT source, text, cast(floor(doc_id / 20) AS bigint) AS k,"
    " cast(floor(doc_id / 240) AS bigint) AS j FROM @documents) d\n"
    + "\n".join(
        f"UNION ALL SELECT source, '{name}', {text} FROM (SELECT DISTINCT source FROM @documents) s"
        for name, text in _MANIFESTS
    )
    + ") c"
)

TABLES = ["documents", "events", "orders", "pages", "conversations", "benchmark", "lineitem"]


def for_duckdb(view: str) -> str:
    for table in TABLES:
        view = view.replace(f"@{table}", table)
    return re.sub(r"@EXPLODE\((\d+), (\d+)\)", r"unnest(generate_series(\1, \2))", view).replace(
        "@OCTETS", "strlen"
    )


def for_spark(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    for table in TABLES:
        if f"@{table}" in view:
            name = f"coppice_{table}"
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(name)
            view = view.replace(f"@{table}", name)
    view = re.sub(r"@EXPLODE\((\d+), (\d+)\)", r"explode(sequence(\1, \2))", view)
    return spark.sql(view.replace("@OCTETS", "octet_length"))
