"""Languages: how a file's is found, and how its lines are told apart.

A line is code, a comment or blank. Grammars cover line comments, block comments
(nested or not) and strings, which hide comment marks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK, CODE, COMMENT, BLANK_IN_COMMENT = 0, 1, 2, 3


@dataclass(frozen=True)
class Grammar:
    name: str
    extensions: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    nested: bool = False
    quotes: tuple[str, ...] = ('"',)
    interpreters: tuple[str, ...] = ()
    all_comment: bool = False


_C = {"line": ("//",), "block": (("/*", "*/"),)}
_HTML = {"block": (("<!--", "-->"),), "quotes": ('"', "'")}
GRAMMARS = (
    Grammar("Plain Text", ("txt", "text"), quotes=(), all_comment=True),
    Grammar("ASP.NET", ("asax", "ascx", "aspx", "master"), **_HTML),
    Grammar("Ada", ("ada", "adb", "ads"), line=("--",)),
    Grammar("Assembly", ("asm",), line=(";",), quotes=('"', "'")),
    Grammar("AWK", ("awk",), line=("#",), interpreters=("awk", "gawk")),
    Grammar("BASH", ("bash",), line=("#",), quotes=('"', "'"), interpreters=("bash",)),
    Grammar("Batch", ("bat", "cmd"), line=("REM", "::"), quotes=()),
    Grammar("C", ("c", "ec", "pgc"), **_C),
    Grammar("C Header", ("h",), **_C),
    Grammar("C#", ("cs", "csx"), **_C),
    Grammar("C++", ("cc", "cpp", "cxx", "c++", "pcc", "tpp"), **_C),
    Grammar("C++ Header", ("hh", "hpp", "hxx", "inl", "ipp"), **_C),
    Grammar("Clojure", ("clj",), line=(";",)),
    Grammar("ClojureScript", ("cljs",), line=(";",)),
    Grammar("ClojureC", ("cljc",), line=(";",)),
    Grammar("CMake", ("cmake",), names=("cmakelists.txt",), line=("#",)),
    Grammar("CoffeeScript", ("coffee", "cjsx"), line=("#",), block=(("###", "###"),), quotes=('"', "'")),
    Grammar("CSS", ("css",), block=(("/*", "*/"),), quotes=('"', "'")),
    Grammar("D", ("d",), nested=True, **_C),
    Grammar("Dart", ("dart",), quotes=('"', "'"), **_C),
    Grammar("Dockerfile", ("dockerfile", "dockerignore"), names=("dockerfile",), line=("#",), quotes=('"', "'")),
    Grammar("Elixir", ("ex", "exs"), line=("#",), quotes=('"""', '"', "'")),
    Grammar("Elm", ("elm",), line=("--",), block=(("{-", "-}"),), nested=True),
    Grammar("Erlang", ("erl", "hrl"), line=("%",)),
    Grammar("F#", ("fs", "fsi", "fsx", "fsscript"), line=("//",), block=(("(*", "*)"),)),
    Grammar("FORTRAN Modern", ("f03", "f08", "f90", "f95", "fpp", "pf"), line=("!",), quotes=('"', "'")),
    Grammar("Go", ("go",), quotes=('"', "`"), **_C),
    Grammar("GraphQL", ("gql", "graphql"), line=("#",)),
    Grammar("Groovy", ("groovy", "grt", "gtpl", "gvy", "gradle"), quotes=('"', "'"), **_C),
    Grammar("Haskell", ("hs",), line=("--",), block=(("{-", "-}"),), nested=True),
    Grammar("HCL", ("hcl", "tf", "tfvars"), line=("#", "//"), block=(("/*", "*/"),)),
    Grammar("HTML", ("html", "htm", "xhtml"), **_HTML),
    Grammar("INI", ("ini",), line=(";", "#"), quotes=()),
    Grammar("Java", ("java",), **_C),
    Grammar("JavaScript", ("js", "mjs", "cjs"), quotes=('"', "'", "`"), interpreters=("node",), **_C),
    Grammar("JSON", ("json",), quotes=()),
    Grammar("JSX", ("jsx",), quotes=('"', "'", "`"), **_C),
    Grammar("Julia", ("jl",), line=("#",), block=(("#=", "=#"),), nested=True),
    Grammar("Kotlin", ("kt", "kts"), nested=True, **_C),
    Grammar("LESS", ("less",), quotes=('"', "'"), **_C),
    Grammar("Lua", ("lua",), line=("--",), block=(("--[[", "]]"),), quotes=('"', "'"), interpreters=("lua",)),
    Grammar("Makefile", ("makefile", "mak", "mk"), names=("makefile",), line=("#",), quotes=()),
    Grammar("Markdown", ("md", "markdown"), quotes=(), all_comment=True),
    Grammar("Objective-C", ("m",), **_C),
    Grammar("OCaml", ("ml", "mli"), block=(("(*", "*)"),), nested=True),
    Grammar("Perl", ("pl", "pm"), line=("#",), block=(("=pod", "=cut"),), quotes=('"', "'"), interpreters=("perl",)),
    Grammar("PHP", ("php",), line=("#", "//"), block=(("/*", "*/"),), quotes=('"', "'"), interpreters=("php",)),
    Grammar("PowerShell", ("ps1", "psm1", "psd1"), line=("#",), block=(("<#", "#>"),), quotes=('"', "'")),
    Grammar("Protocol Buffers", ("proto",), line=("//",)),
    Grammar("Python", ("py", "pyw"), line=("#",), quotes=('"""', "'''", '"', "'"), interpreters=("python", "python2", "python3")),
    Grammar("R", ("r",), line=("#",), quotes=('"', "'"), interpreters=("Rscript",)),
    Grammar("ReStructuredText", ("rst",), quotes=(), all_comment=True),
    Grammar("Ruby", ("rb", "rake"), names=("rakefile", "gemfile"), line=("#",), block=(("=begin", "=end"),), quotes=('"', "'"), interpreters=("ruby",)),
    Grammar("Rust", ("rs",), nested=True, **_C),
    Grammar("Sass", ("sass", "scss"), quotes=('"', "'"), **_C),
    Grammar("Scala", ("sc", "scala"), nested=True, **_C),
    Grammar("Shell", ("sh",), line=("#",), quotes=('"', "'"), interpreters=("sh",)),
    Grammar("SQL", ("sql",), line=("--",), block=(("/*", "*/"),), quotes=("'",)),
    Grammar("SVG", ("svg",), **_HTML),
    Grammar("Swift", ("swift",), nested=True, **_C),
    Grammar("TOML", ("toml",), line=("#",), quotes=('"""', "'''", '"', "'")),
    Grammar("TSX", ("tsx",), quotes=('"', "'", "`"), **_C),
    Grammar("TypeScript", ("ts", "mts", "cts"), quotes=('"', "'", "`"), **_C),
    Grammar("Vue", ("vue",), **_HTML),
    Grammar("XML", ("xml", "xsd", "xsl", "xslt"), **_HTML),
    Grammar("YAML", ("yaml", "yml"), line=("#",), quotes=('"', "'")),
    Grammar("Zig", ("zig",), line=("//",)),
    Grammar("Properties", ("properties",), line=("#", "!"), quotes=()),
)
BY_NAME = {g.name: g for g in GRAMMARS}


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in sorted(pairs.items()) for x in pair)), key)


def extension(name: Column) -> Column:
    """What stands behind the last dot of a file name; null for none, and for names whose only dot comes first."""
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def known_language(name: Column, text: Column | None = None) -> Column:
    """A language by file name, extension or interpreter line; null where it is unknown."""
    by_name = _lookup({n: g.name for g in GRAMMARS for n in g.names}, F.lower(name))
    by_extension = _lookup({e: g.name for g in GRAMMARS for e in g.extensions}, F.lower(extension(name)))
    found = F.coalesce(by_name, by_extension)
    if text is None:
        return found
    interpreter = F.regexp_extract(text, r"^#!\s*(?:\S*/env\s+)?(?:\S*/)?([^\s/]+)", 1)
    return F.coalesce(found, _lookup({i: g.name for g in GRAMMARS for i in g.interpreters}, interpreter))


def language(name: Column, known: Column) -> Column:
    """The known language, else the extension, else no_extension."""
    return F.coalesce(known, extension(name), F.lit("no_extension"))


def classify(text: str, grammar: Grammar) -> list[int]:
    """The class of every line; a last line without characters isn't one."""
    rows = text.split("\n")
    if rows and not rows[-1]:
        rows.pop()
    if grammar.all_comment:
        return [COMMENT if r.strip() else BLANK for r in rows]
    openers = {o: c for o, c in grammar.block}
    marks = sorted({*openers, *grammar.line, *grammar.quotes}, key=len, reverse=True)
    find = re.compile("|".join(map(re.escape, marks))) if marks else None
    out, closing, depth, quote = [], "", 0, ""
    for row in rows:
        stripped = row.strip()
        if not stripped:
            out.append(BLANK_IN_COMMENT if depth else CODE if quote else BLANK)
            continue
        code, at = bool(quote), 0
        while at < len(row):
            if depth:
                opener = next(o for o, c in grammar.block if c == closing)
                end, again = row.find(closing, at), row.find(opener, at) if grammar.nested else -1
                if again >= 0 and (end < 0 or again < end):
                    depth, at = depth + 1, again + len(opener)
                elif end >= 0:
                    depth, at = depth - 1, end + len(closing)
                else:
                    at = len(row)
            elif quote:
                end = row.find(quote, at)
                while end > 0 and row[end - 1] == "\\" and (end < 2 or row[end - 2] != "\\"):
                    end = row.find(quote, end + 1)
                if end < 0:
                    quote, at = quote if len(quote) == 3 or quote == "`" else "", len(row)
                else:
                    at, quote = end + len(quote), ""
            else:
                match = find.search(row, at) if find else None
                before = row[at : match.start()] if match else row[at:]
                code = code or bool(before.strip())
                if not match:
                    break
                mark, at = match.group(), match.end()
                if mark in openers:
                    closing, depth = openers[mark], 1
                elif mark in grammar.line:
                    break
                else:
                    quote, code = mark, True
        out.append(CODE if code else COMMENT)
    return out


@F.pandas_udf(T.ArrayType(T.ByteType()))
def line_classes(names: pd.Series, texts: pd.Series) -> pd.Series:
    """Classes of all lines of a text in a language; null where the language is unknown."""
    return pd.Series([classify(t, BY_NAME[n]) if n in BY_NAME and t is not None else None for n, t in zip(names, texts)])
