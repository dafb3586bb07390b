"""One object for all questions to an index, with the commands of a code browser's menu."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.formats import render
from loomdex.functions.text import highlight
from loomdex.operators import grep, reports, search
from loomdex.operators.patterns import is_regex, quote
from loomdex.sources import index


@dataclass(frozen=True)
class Index:
    """files (fid, path, kind, ...), defs (key, tag, fid, path, repo, lineno, image), refs (key, tag, path, lineno) and
    lines (path, lineno, image); every method returns a lazy DataFrame."""

    files: DataFrame
    defs: DataFrame
    refs: DataFrame
    lines: DataFrame
    icase: bool = False
    libraries: tuple[str, ...] = ()  # projects (column repo of defs), the own one first; without them all are one

    @classmethod
    def of_tables(cls, spark: SparkSession, folder: str) -> Index:
        """Over the tables of a data folder."""
        return cls(index.files(spark, folder), index.definitions(spark, folder), index.references(spark, folder), index.lines(spark, folder))

    def with_case(self, icase: bool) -> Index:
        return replace(self, icase=icase)

    def with_libraries(self, *libraries: str) -> Index:
        """Definitions and completions are looked for in the own project, the first, and only if it has none in the next ones."""
        return replace(self, libraries=libraries)

    def _own(self) -> DataFrame:
        return self.defs.filter(F.col("repo") == self.libraries[0]) if self.libraries else self.defs

    # --- symbols ---
    def definitions(self, pattern: str | None, **kw: object) -> DataFrame:
        hits = search.search(self.defs, pattern, icase=self.icase, **kw)
        return search.first_library(hits, list(self.libraries), None).drop("lib_rank") if self.libraries else hits

    def references(self, pattern: str | None, **kw: object) -> DataFrame:
        """References whose key is defined."""
        return search.resolved(search.search(self.refs, pattern, icase=self.icase, **kw), self.defs)

    def symbols(self, pattern: str | None, **kw: object) -> DataFrame:
        """Other symbols: those whose key isn't defined."""
        return search.unresolved(search.search(self.refs, pattern, icase=self.icase, **kw), self.defs)

    def everything(self, pattern: str | None, **kw: object) -> DataFrame:
        return search.everything(self.defs, self.refs, pattern, icase=self.icase, **kw)

    def from_here(self, key: str, path: str, lineno: int) -> DataFrame:
        """What the symbol at a place asks for: references at a definition, definitions of a known key, else symbols.
        Patterns are refused."""
        if is_regex(key):
            raise ValueError("a place has a name, not a pattern")
        spark = self.defs.sparkSession
        libraries = self.defs.filter(~F.col("repo").isin(list(self.libraries[:1]))) if self.libraries else None
        target = search.resolve_context(spark.createDataFrame([(key, path, lineno)], "key string, path string, lineno int"), self._own(), libraries).first().target
        return {"references": self.references, "definitions": self.definitions, "symbols": self.symbols}[target](key)

    def complete(self, prefix: str, limit: int | None = None) -> DataFrame:
        out = search.complete(self.defs, prefix, self.icase, list(self.libraries))
        return out.orderBy("key").limit(limit) if limit else out

    # --- lines and paths ---
    def grep(self, pattern: str, kinds: tuple[str, ...] = ("source",), **kw: object) -> DataFrame:
        """Lines of files of the given kinds."""
        of = self.files.filter(F.col("kind").isin(list(kinds))).select("path").distinct()
        return grep.grep(self.lines, pattern, icase=self.icase, **kw).join(of, "path", "left_semi")

    def paths(self, pattern: str | None, **kw: object) -> DataFrame:
        return grep.find_paths(self.files, pattern, icase=self.icase, **kw)

    def includers(self, name: str) -> DataFrame:
        """Lines that include a file of this name."""
        return grep.grep(self.lines, r'^[[:blank:]]*#[[:blank:]]*include[[:blank:]].*["</]' + quote(name) + '[">]')

    def assignments(self, name: str) -> DataFrame:
        """Definitions and references of the symbol whose line assigns to it."""
        hit = F.col("image").rlike(r"\b" + quote(name) + r"\b[ \t]*=[^=]")
        at = self.everything(name, literal=True).select("path", "lineno").distinct()
        return self.lines.filter(hit).join(at, ["path", "lineno"], "left_semi")

    def called(self, name: str) -> DataFrame:
        """References, of keys that are defined, from the lines of the functions of this name: those whose last definition at or
        above the line it is."""
        inside = reports.enclosing(search.resolved(self.refs, self.defs), self.defs).filter(F.col("enclosing") == name)
        return inside.select("tag", "path", "lineno")

    def change(self, text: str) -> DataFrame:
        """Lines with the text, and the line with the text marked."""
        return self.grep(text, literal=True).withColumn("image", highlight(F.col("image"), quote(text)))

    # --- answers as text ---
    def show(self, rows: DataFrame, kind: str = "ctags-x") -> DataFrame:
        """Rows as lines of output; images that rows lack come from the lines, empty where a line is unknown."""
        if "image" not in rows.columns and "lineno" in rows.columns:
            one = self.lines.groupBy("path", "lineno").agg(F.min("image").alias("image"))
            rows = rows.join(one, ["path", "lineno"], "left")
        for name, of in (("tag", "string"), ("lineno", "int"), ("fid", "long"), ("image", "string")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(of))
        return render(rows, kind)

    def single(self, rows: DataFrame) -> DataFrame | None:
        """The row of a result that has exactly one, to go there at once."""
        two = rows.limit(2)
        return two if two.count() == 1 else None

    def command(self, line: str) -> DataFrame | None:
        """A line of the browser's menu: a digit and what to look for. 0 symbol, 1 definition, 2 what a function calls, 3
        references, 4 text, 5 a preview of text to be changed, 6 regular expression, 7 file, 8 includers, 9 assignments; null for other lines. Kind, path, tag and line come out
        where they apply."""
        ask, what = line[:1], line[1:].strip()
        if not what:
            return None
        plan = {
            "0": lambda: self.everything(what),
            "1": lambda: self.definitions(what),
            "2": lambda: self.called(what),
            "3": lambda: self.references(what),
            "5": lambda: self.change(what),
            "4": lambda: self.grep(what, literal=True),
            "6": lambda: self.grep(what),
            "7": lambda: self.paths(what),
            "8": lambda: self.includers(what),
            "9": lambda: self.assignments(what),
        }.get(ask)
        return plan() if plan else None

    def pages(self) -> dict[str, DataFrame]:
        """All reports: duplicates, titles, alphabet, directories, includes, navigation."""
        dup = reports.duplicates(self.defs)
        return {"duplicates": dup, "titles": reports.tooltip(dup), "alphabet": reports.alphabet(self.defs), "directories": reports.directories(self.files), "entries": reports.duplicate_entries(self.defs), "includes": reports.includes(self.lines, self.files), "navigation": reports.navigation(self.defs)}


class Menu:
    """The browser's session: lines of ``Index.command``, c to turn case on and off, r to rebuild, q to quit."""

    def __init__(self, index: Index, rebuild=None) -> None:
        self.index, self.rebuild, self.open = index, rebuild, True

    def run(self, line: str) -> DataFrame | None:
        """The answer to one line; null for lines that have none."""
        if line == "c":
            self.index = self.index.with_case(not self.index.icase)
        elif line == "r" and self.rebuild:
            self.index = self.rebuild()
        elif line == "q":
            self.open = False
        elif self.open:
            return self.index.command(line)
        return None
