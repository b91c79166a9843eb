"""One object for a set of trees, with a method per report.

Every method returns a DataFrame.  What several reports share is worked out once
and written to the checkpoint folder: bodies are read as few times as possible.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators import (
    budget,
    diff,
    dupes,
    graph,
    history,
    imports,
    markers,
    resolve,
    rollup,
    summary,
    testsgap,
    tree,
    visible,
)
from coppice.operators import symbols as symbol_ops
from coppice.schema import ENTRY, TREE
from coppice.session import cut
from coppice.sinks import report
from coppice.sources import trees


class Trees:
    """Inventories and bodies of any number of trees, plus optional histories."""

    def __init__(
        self,
        files: DataFrame,
        contents: DataFrame,
        commits: DataFrame | None = None,
        commit_files: DataFrame | None = None,
        status: DataFrame | None = None,
        changes: DataFrame | None = None,
        ignored_paths: DataFrame | None = None,
        limit: int | None = None,
        keywords: list[str] = markers.KEYWORDS,
        **filters,
    ):
        self.files = trees.with_directories(files)
        self.contents = trees.bodies(contents, limit)
        self.commits, self.commit_files = commits, commit_files
        self.status, self.changes = status, changes
        self.ignored_paths = ignored_paths
        self.limit, self.keywords, self.filters = limit, keywords, filters
        self._raw_contents = contents

    @cached_property
    def manifests(self) -> DataFrame:
        """Manifests and ignore files of all trees, hidden ones included."""
        return cut(trees.manifest_bodies(self.contents), "manifests")

    @cached_property
    def listed(self) -> DataFrame:
        """Entries left by the filters."""
        options = dict(self.filters)
        if options.pop("use_ignore", True):
            options.setdefault("ignored_paths", self.ignored_paths)
            options.setdefault("rules", trees.ignore_rules(self.manifests))
        if options.pop("changed_only", False):
            options["since"] = self.since_marks
        return cut(visible.visible(self.files, **options), "listed")

    @cached_property
    def bodies(self) -> DataFrame:
        """Bodies, less those a look at the path alone rules out.

        Bodies are never joined with the listing: each analysis runs where they
        are read, and only its narrow result is cut to the listed files.
        """
        if self.filters.get("show_all"):
            return self.contents
        return visible.not_hidden(self.contents)

    def _of_listed(self, df: DataFrame, column: str = "path") -> DataFrame:
        kept = self.listed.where(F.col("kind") != "dir").select(*TREE, F.col("path").alias(column))
        return df.join(kept, [*TREE, column], "left_semi")

    @cached_property
    def listed_manifests(self) -> DataFrame:
        return self._of_listed(self.manifests)

    @cached_property
    def counts(self) -> DataFrame:
        return cut(self._of_listed(trees.text_counts(self._raw_contents, self.limit)), "counts")

    @cached_property
    def todos(self) -> DataFrame:
        return cut(self._of_listed(markers.scan(self.bodies, self.keywords)), "todos")

    @cached_property
    def symbols(self) -> DataFrame:
        found = symbol_ops.symbols(self.bodies)
        return cut(self._of_listed(found), "symbols")

    @cached_property
    def resolved(self) -> DataFrame:
        raw = imports.raw_imports(self.bodies)
        return cut(
            resolve.resolve(
                cut(self._of_listed(raw, "src"), "imports"),
                self.listed,
                trees.go_modules(self.listed_manifests),
                trees.ts_options(self.listed_manifests),
                trees.package_aliases(self.listed_manifests),
                trees.cargo_dirs(self.listed),
            ),
            "resolved",
        )

    @cached_property
    def edges(self) -> DataFrame:
        return cut(resolve.edges(self.resolved), "edges")

    @cached_property
    def externals(self) -> DataFrame:
        return resolve.externals(self.resolved)

    @cached_property
    def entries(self) -> DataFrame:
        named = trees.package_entries(self.listed_manifests, self.listed)
        return cut(testsgap.entry_points(self.listed, named), "entries")

    @cached_property
    def components(self) -> DataFrame:
        return cut(graph.components(self.edges), "components")

    @cached_property
    def untested(self) -> DataFrame:
        return cut(
            testsgap.untested(self.listed, self.edges, imports.inline_tested(self.bodies)), "untested"
        )

    @cached_property
    def since_marks(self) -> DataFrame:
        return history.since_marks(self.changes, self.status)

    @cached_property
    def last_commits(self) -> DataFrame | None:
        if self.commits is None:
            return None
        return history.last_commits(self.commits, self.commit_files)

    @cached_property
    def churn(self) -> DataFrame | None:
        if self.commits is None:
            return None
        return history.churn(self.commit_files)

    @cached_property
    def annotated(self) -> DataFrame:
        joined = summary.annotate(
            self.listed,
            self.counts,
            self.todos,
            self.symbols,
            self.edges,
            self.externals,
            self.entries,
            testsgap.config_files(self.listed),
            self.untested,
            self.last_commits,
            self.status,
        )
        return cut(joined, "annotated")

    # -------------------------------------------------------------- reports

    def analyze(self) -> DataFrame:
        """One summary row per tree."""
        return summary.project_summary(
            self.annotated, self.edges, self.components, self.churn, self.entries, self.symbols
        )

    def tree(
        self, sort: str = "name", reverse: bool = False, annotated: bool = False, now: float | None = None, bars: bool = False, modes: bool = False, owners: bool = False
    ) -> DataFrame:
        """Text lines of the trees, in listing order."""
        sizes = rollup.directory_sizes(self.files)
        notes = tree.entry_notes(self.listed, self.annotated if annotated else None, sizes, now, bars, modes, owners)
        return tree.tree_lines(self.listed, notes, sort, reverse, sizes=sizes)

    def outline(self, public_only: bool = False) -> DataFrame:
        return symbol_ops.public(self.symbols) if public_only else self.symbols

    def imports(self, limit: int | None = None) -> DataFrame:
        return report.flat_imports(self.edges, self.externals, limit)

    def focus(self, requested: DataFrame) -> dict[str, DataFrame]:
        """Everything around some files: both impact sets, cycles, externals, hints."""
        return {
            "depends_on": graph.impact_in_order(self.edges, requested),
            "depended_on_by": graph.impact_in_order(self.edges, requested, reverse=True),
            "external_imports": graph.externals_of(self.externals, requested),
            "cycles": graph.cycles_of(self.components, requested),
            "hints": graph.manifest_hints(requested, self.listed),
            "did_you_mean": graph.suggestions(requested, self.edges),
        }

    def todo_list(self, limit: int | None = None) -> DataFrame:
        return report.flat_todos(self.todos, limit)

    def since(self) -> DataFrame:
        """Listed files changed since the reference, with their mark."""
        return history.overlay(
            visible.changed_only(self.listed, self.since_marks), self.status, self.since_marks
        )

    def history(self, n: int = 5) -> DataFrame:
        return history.hotspots(self.churn, n)

    def api_diff(self, baseline: Trees) -> DataFrame:
        return diff.api_diff(baseline.symbols, self.symbols, self.changes, self.status)

    def top(self, n: int) -> DataFrame:
        return tree.largest(self.listed, n, sizes=rollup.directory_sizes(self.files))

    def dupes(self, across: bool = False) -> DataFrame:
        bodies = dupes.of_repeated_size(self.bodies, self.files, across)
        return dupes.groups(self._of_listed(dupes.digests(bodies)), across)

    def compare(self, other: Trees) -> DataFrame:
        sides = [t._of_listed(diff.sized_digests(t.bodies)) for t in (self, other)]
        return diff.compare_digests(*sides)

    def csv(self) -> DataFrame:
        return report.file_report(self.annotated)

    def pack(self) -> DataFrame:
        """A section per listed file: the one report that has to carry bodies along."""
        return report.pack(self._of_listed(self.bodies))

    def estimate(self, cap: int | None = None) -> DataFrame:
        return budget.estimate(self.tree(annotated=True), self.tree(), cap)

    def budget(self, tokens: int) -> DataFrame:
        """Listing lines cut to a number of tokens per tree."""
        sizes = rollup.directory_sizes(self.files)
        without_symbols = self.annotated.withColumn("outline", F.lit(None).cast("string"))
        plain = tree.tree_lines(
            self.listed, tree.entry_notes(self.listed, without_symbols, sizes)
        )
        return budget.fit(self.tree(annotated=True), plain, self.tree(), tokens)

    def errors(self) -> DataFrame:
        return report.error_rows(self.files.select(*TREE), self.commits, self.ignored_paths)
