"""Measures of source code and of documents with code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.functions import words as W


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def by_language(language: Column, of: dict[str, Column], default: str = "javascript") -> Column:
    """The column of the row's language."""
    out = F.when(F.lit(False), of[default])
    for name, column in of.items():
        out = out.when(language == name, column)
    return out.otherwise(of[default])


def without_comments(code: Column, language: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(code, "(?m)//.*$", ""), "/\\*[\\s\\S]*?\\*/", "")
    python = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "(?m)#.*$", ""), '"""[\\s\\S]*?"""', ""), "'''[\\s\\S]*?'''", "")
    return F.when(language == "python", python).otherwise(out)


def nesting(code: Column, language: Column) -> Column:
    """The deepest nesting: of brackets at the end of a line, in Python of four spaces."""
    net = lambda line: F.regexp_count(line, F.lit("[{(\\[]")) - F.regexp_count(line, F.lit("[})\\]]"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    fold = lambda s, line: F.struct((s["now"] + net(line)).cast("int").alias("now"), F.greatest(s["most"], s["now"] + net(line)).cast("int").alias("most"))
    lines = F.split(code, "\n")
    indents = F.array_max(F.transform(lines, lambda x: F.floor(F.length(F.regexp_extract(x, "^(\\s*)", 1)) / 4).cast("int")))
    return F.when(language == "python", indents).otherwise(F.aggregate(lines, start, fold, lambda s: s["most"]))


def comment_ratio(code: Column, language: Column) -> Column:
    """Percent of lines that are comments or lie in a block comment."""
    lines = F.transform(F.split(code, "\n"), trimmed)
    python = F.size(F.filter(lines, lambda x: x.startswith("#") | x.startswith('"""') | x.startswith("'''")))
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"))

    def fold(s, x):
        opens = x.startswith("//") | x.startswith("/*")
        inside = F.when(s["inside"], ~x.contains("*/")).otherwise(opens & x.contains("/*") & ~x.contains("*/"))
        return F.struct(inside.alias("inside"), (s["n"] + (s["inside"] | opens).cast("int")).alias("n"))

    n = F.when(language == "python", python).otherwise(F.aggregate(lines, start, fold, lambda s: s["n"]))
    return F.round(n / F.size(lines) * 100).cast("int")


def complexity(code: Column, language: Column) -> Column:
    """1, the number of branches, and 2 for each level of nesting beyond four."""
    bare = without_comments(code, language)
    branches = by_language(language, {name: F.regexp_count(bare, F.lit(S.ascii_bounds(p))) for name, p in W.BRANCHES.items()})
    return (1 + branches + 2 * F.greatest(F.lit(0), nesting(code, language) - 4)).cast("int")


def rating(cyclomatic: Column) -> Column:
    return F.when(cyclomatic <= 10, "A").when(cyclomatic <= 20, "B").when(cyclomatic <= 40, "C").otherwise("D")


def antipatterns(code: Column, language: Column) -> Column:
    """Array of (name, severity) of the patterns to avoid that the code shows."""
    lines, js = F.split(code, "\n"), language == "javascript"
    long_lines = F.filter(F.transform(lines, trimmed), lambda x: F.length(x) > 20)
    magic = F.regexp_count(code, F.lit(W.MAGIC + "(?![a-zA-Z_])"))
    checks = [
        ("long", "warning", F.size(lines) > 100), ("nesting", "warning", nesting(code, language) > 4), ("magic", "info", magic > 3), ("catch", "error", code.rlike(W.CATCH_EMPTY)),
        ("console", "info", js & code.rlike(W.CONSOLE)), ("credentials", "critical", code.rlike(W.CREDENTIALS)), ("sql", "critical", code.rlike(W.SQL_BUILT)), ("eval", "critical", code.rlike(S.ascii_bounds(W.EVAL))),
        ("var", "info", js & code.rlike(S.ascii_bounds(W.VAR))), ("async", "warning", code.rlike(W.ASYNC) & ~code.rlike(W.TRY)), ("todo", "info", code.rlike(W.TODO)),
        ("duplicates", "warning", F.size(long_lines) - F.size(F.array_distinct(long_lines)) > 3),
    ]
    found = F.array(*(F.when(hit, F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"))) for name, severity, hit in checks))
    return F.filter(found, lambda x: x.isNotNull())


def quality_score(cyclomatic: Column, depth: Column, comments: Column, found: Column) -> Column:
    """0 to 100, less for complexity, nesting, patterns to avoid and few comments."""
    of = lambda severity: F.size(F.filter(found, lambda x: x["severity"] == severity))
    costs = sum((cost * of(severity) for severity, cost in W.SEVERITY_COSTS), F.lit(0))
    score = 100 - 2 * F.greatest(F.lit(0), cyclomatic - 10) - 5 * F.greatest(F.lit(0), depth - 4) - costs
    score = score + F.when(comments < 5, -10).when(comments > 30, 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def language_of(code: Column) -> Column:
    """A guess from telling strings."""
    return S.first_match([(S.any_of(code, w), n) for w, n in W.CODE_LANGUAGES], "cpp")


def code_blocks(text: Column) -> Column:
    """Array of (code, language): fenced blocks of more than 20 characters; without one, function definitions."""
    pattern = F.lit("```(\\w+)?\\n([\\s\\S]*?)```")
    pair = lambda code, marked: F.struct(code.alias("code"), F.when(marked != "", marked).otherwise(language_of(code)).alias("language"))
    fenced = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda m, c: pair(trimmed(c), m))
    fenced = F.filter(fenced, lambda x: F.length(x["code"]) > 20)
    defined = F.transform(F.regexp_extract_all(text, F.lit(W.FUNCTIONS), F.lit(0)), lambda c: pair(c, F.lit("")))
    return F.when(F.size(fenced) > 0, fenced).otherwise(defined)


def commands(text: Column, terms: list[str]) -> Column:
    """Array of (command, description, score) of fenced blocks that hold a term, 2 for each, or have it near, 1."""
    lines = F.split(text, "\n")
    fence = lambda i: trimmed(F.element_at(lines, i)).startswith("```")
    fences = F.filter(F.sequence(F.lit(1), F.size(lines)), fence)
    part = lambda a, b: F.array_join(F.slice(lines, a, F.greatest(F.lit(0), b - a + 1)), "\n")

    def block(k):
        s, e = F.element_at(fences, 2 * k - 1), F.element_at(fences, 2 * k)
        code = trimmed(part(s + 1, e - 1))
        near = F.lower(part(F.greatest(F.lit(1), s - 3), F.least(F.size(lines), e + 1)))
        score = sum((F.when(F.lower(code).contains(t), 2).when(near.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
        said = F.substring(trimmed(F.regexp_replace(F.when(s > 1, F.element_at(lines, F.greatest(F.lit(1), s - 1))).otherwise(""), "^[-*#\\s]+", "")), 1, 100)
        mark = F.regexp_extract(trimmed(F.element_at(lines, s)), "^```(\\w*)", 1)
        default = F.concat(F.lit("CLI command ("), F.when(mark != "", mark).otherwise("shell"), F.lit(")"))
        return F.struct(code.alias("command"), F.when(said != "", said).otherwise(default).alias("description"), score.alias("score"))

    pairs = F.floor(F.size(fences) / 2).cast("int")
    blocks = F.when(pairs > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), pairs)), block)).otherwise(F.array().cast("array<struct<command:string,description:string,score:int>>"))
    return F.filter(blocks, lambda x: (x["score"] > 0) & (F.length(x["command"]) > 0) & (F.length(x["command"]) < 2000))


def section(text: Column, anchor: Column, most: int = 3000) -> Column:
    """The section under the heading that names the anchor, or is in it; without one the whole text.

    It ends at the next heading of its level or above, and after ``most`` characters.
    """
    wanted = F.regexp_replace(F.lower(anchor), "-", " ")
    level = lambda line: F.length(F.regexp_extract(line, "^(#{1,6})\\s+.+", 1))
    title = lambda line: F.lower(F.regexp_extract(line, "^#{1,6}\\s+(.+)", 1))
    start = F.struct(F.lit(0).alias("level"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("kept"))

    def fold(s, line):
        names = ~s["over"] & (level(line) > 0) & (F.contains(title(line), wanted) | F.contains(wanted, title(line)))
        ends = ~names & (s["level"] > 0) & (level(line) > 0) & (level(line) <= s["level"])
        now, over = F.when(names, level(line)).otherwise(s["level"]), s["over"] | ends
        return F.struct(now.alias("level"), over.alias("over"), F.when((now > 0) & ~over, F.concat(s["kept"], F.array(line))).otherwise(s["kept"]).alias("kept"))

    kept = F.aggregate(F.split(text, "\n"), start, fold, lambda s: s["kept"])
    return F.when(F.size(kept) > 0, F.substring(F.array_join(kept, "\n"), 1, most)).otherwise(text)
