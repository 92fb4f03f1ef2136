"""Texts that storage or transfer cut off."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.timeparse import clean_key
from trackloom.plans.joins import cell_join
from trackloom.plans.stage import staged

#: A last line with changing numbers is a feed's stamp if this share of the feed, and this many texts, end so.
STAMP_SHARE, STAMP_LEAST = 0.005, 5
#: A length is a limit of the feed if this share of its texts, and this many, have exactly it.
LIMIT_SHARE, LIMIT_LEAST = 0.01, 5
#: Ends with a bare formula are a feed's habit from this share of its pieces on.
FORMULA_SHARE = 0.03
#: A kind of end counts as expected in a feed if at least this share of its texts of that kind have it.
BASELINE = 0.5

_TOKENS = re.compile(r"\\(begin|end)\s*\{\s*([^{}\n]*?)\s*\}|\\(?P<opens>documentclass|documentstyle|magnification)(?![A-Za-z])|\\(?P<shuts>bye(?![A-Za-z])|end[ \t\r]*(?=\n|\Z))|\\verb\*?(?P<mark>[^\sA-Za-z*]).*?(?P=mark)|\\.|\$\$|[{}$]|(?<!\\)%[^\n]*|\n[ \t\r]*\n|``|''|[()\[\]“”„\"]", re.S)
_FORMULA = re.compile(r"\$|\\[\[(]|(?:equation|align|eqnarray|gather|multline|displaymath|math|array|tikzpicture)")
_OPENING, _CLOSING = {"(": ")", "[": ")", "“": "”", "„": "”", "``": "”"}, {")": ")", "]": ")", "”": "”", "''": "”", '"': "”"}
#: What ends at the latest with its paragraph.
_PARAGRAPH = {"{", "$", "$$", "\\[", "\\(", *_OPENING}
_LAST_COMMENTS = re.compile(r"(?:\n|^)[ \t]*%[^\n]*$")
_SENTENCE = re.compile(r"(?:[.!?。!?]|\\l?dots|\.~)[\"”’»')\]}$]*$")
_COMMAND_LINE = re.compile(r"(?:^|\n)[ \t]*(?:\\[A-Za-z@]+\*?(?:\[[^\]\n]*\])*(?:\{[^{}\n]*\})*[ \t]*)+$|\\end\s*\{[^{}\n]+\}$|\\\]$")
#: What abstracts carry behind their last sentence.
_APPENDED = re.compile(r"(?:^|\n|[.!?)] )(?:key ?words?(?: and phrases)?[.:][^.\n]*|\(?\d+ pages?[^\n]*|comments? (?:are )?welcome!?)$", re.I)
#: What a cut within a character or an escape leaves: half of a multibyte sequence, a lone escape sign, half an entity or code.
_BROKEN = re.compile("(?:[\ufffd\ud800-\udfff\x80-\x9f]|(?<!\\\\)(?:\\\\\\\\)*\\\\|&(?:#[xX]?[0-9A-Fa-f]*|[A-Za-z]{1,8})|\\\\u[0-9A-Fa-f]{0,3})$")


def scan(text: str) -> tuple[list[str], bool, bool]:
    """What a stack automaton over the markup still holds at the end of ``text``; whether it is a whole article, and whether that was closed.

    Environments nest by name; braces and formulas end at the latest with their
    paragraph, so a stray sign early in a text doesn't count against its end; so
    do brackets and quotes of prose, either bracket closing either, as in
    half-open intervals.  A straight quote only closes, as it doesn't tell what
    it is.  Comments, escaped signs and verbatim text are passed over.  A class
    command or the beginning of the document opens an article, which its closing
    command closes; the automaton stops there, whatever is left behind it.
    """
    stack: list[str] = []
    verbatim = ""
    article = False
    for m in _TOKENS.finditer(text):
        kind = m.group(1)
        sign = m.group()
        if article and (kind == "end" and m.group(2) == "document" or m.group("shuts") and not verbatim):
            return [], True, True
        if verbatim:
            if kind == "end" and m.group(2) == verbatim:
                verbatim = ""
            continue
        if m.group("opens") or kind == "begin" and m.group(2) == "document":
            if not article:
                # what was open before an article's first command is none of its business
                article, stack = True, ["document"]
        elif kind == "begin":
            if m.group(2) in ("verbatim", "lstlisting", "comment"):
                verbatim = m.group(2)
            else:
                stack.append(m.group(2))
        elif kind == "end":
            if m.group(2) in stack:
                while stack.pop() != m.group(2):
                    pass
        elif sign == "{":
            stack.append("{")
        elif sign == "}":
            while stack and (stack[-1] in ("$", "$$") or stack[-1] in _OPENING):
                stack.pop()
            if stack and stack[-1] == "{":
                stack.pop()
        elif sign in ("$", "$$"):
            if sign in stack and all(x in ("{", sign) for x in stack[stack.index(sign) :]):
                del stack[stack.index(sign) :]
            else:
                stack.append(sign)
        elif sign == "\\[":
            stack.append("\\[")
        elif sign == "\\]":
            if "\\[" in stack:
                del stack[len(stack) - 1 - stack[::-1].index("\\[") :]
        elif sign == "\\(":
            stack.append("\\(")
        elif sign == "\\)":
            if "\\(" in stack:
                del stack[len(stack) - 1 - stack[::-1].index("\\(") :]
        elif sign[0] == "\n":
            if stack:
                stack = [x for x in stack if x not in _PARAGRAPH]
        elif sign[0] in "\\%" or any(_FORMULA.match(x) for x in stack):
            continue
        elif sign in _OPENING and not (sign == "“" and "„" in stack):
            stack.append(sign)
        elif sign in _CLOSING or sign == "“":
            what = _CLOSING.get(sign, "”")
            at = [i for i, x in enumerate(stack) if _OPENING.get(x) == what]
            if at:
                del stack[at[-1]]
    if verbatim:
        stack.append(verbatim)
    return stack, article, False


def examine(text: str, stamp: re.Pattern[str] | None) -> tuple[str, bool, bool, bool, str, int, int]:
    """(kind, ended, formula, in_comment, open, chars, bytes) of a text without its stamp.

    The automaton runs over the whole text.  kind is 'file' for whole articles,
    'piece' for parts of one, 'none' without content.  ended: the automaton saw a
    file's closing command; a piece closes all it opened and ends with a
    sentence, a command or an environment; formula: with a closed formula and
    nothing behind it, which may be either.  in_comment: the text ends with a
    comment that stops without a full stop.  open is all that is still held.
    """
    body = text
    if stamp and (m := stamp.search(body)):
        body = body[: m.start()]
    chars, size = len(body), len(body.encode("utf-8", "surrogatepass"))
    bare = body.rstrip().rstrip("\u200b\ufeff\x00").rstrip()
    cut_mark = bare.endswith(("…", "...", "[...]", "[…]"))
    core = bare
    while (m := _LAST_COMMENTS.search(core)) is not None:
        core = core[: m.start()].rstrip()
    in_comment = core != bare and not re.search(r"[.!?:。-]\s*$", bare)
    if cut_mark:
        core = core.rstrip("….[] ")
    held, article, closed = scan(core)
    if article:
        return "file", closed, False, False, " ".join(held), chars, size
    if not core and not cut_mark:
        return "none", True, False, in_comment, "", chars, size
    ended = not held and not _BROKEN.search(core) and not cut_mark and bool(_SENTENCE.search(core) or _COMMAND_LINE.search(core) or _APPENDED.search(core))
    formula = not ended and not held and not cut_mark and core.endswith("$")
    return "piece", ended, formula, in_comment, " ".join(held), chars, size


def _last_line(text: Column) -> Column:
    """The last line that isn't blank, however long."""
    return F.btrim(F.substring_index(F.rtrim(F.translate(text, "\r\t", "\n "), F.lit(" \n")), "\n", -1))


def _numbers_out(line: Column) -> Column:
    """The line with its numbers as #; null if it has none."""
    return F.when(line.rlike(r"\d"), F.regexp_replace(line, r"\d+", "#"))


def _stamps(docs: DataFrame) -> dict[str, re.Pattern[str]]:
    """For each source, what its stamps look like; at most 1 / STAMP_SHARE a source.

    Lines are counted by hash and source before the shuffle, and a source's total
    is summed and joined, so no source is gathered in one task.  Only for the
    hashes that turn out common a document is read again for the line itself.
    """
    lines = docs.select("source", "doc_id", _last_line(F.col("text")).alias("line"))
    tails = lines.select("source", "doc_id", F.xxhash64("line").alias("number"), _numbers_out(F.col("line")).alias("tail")).select("source", "doc_id", "number", F.when(F.col("tail").isNotNull(), F.xxhash64("tail")).alias("tail"))
    counts = staged(tails.groupBy("source", "tail").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("number").alias("numbers"), F.min("doc_id").alias("doc_id")))
    totals = counts.groupBy("source").agg(F.sum("n").alias("all"))
    common = staged(counts.where((F.col("n") >= STAMP_LEAST) & (F.col("numbers") >= F.col("n") * 0.5) & F.col("tail").isNotNull()).join(totals, "source").where(F.col("n") >= F.col("all") * STAMP_SHARE).select("source", "tail", "doc_id"))
    lines = cell_join(docs, common.select("source", "doc_id", "tail"), ["source", "doc_id"]).select("source", "tail", _numbers_out(_last_line(F.col("text"))).alias("line")).where(F.xxhash64("line") == F.col("tail")).distinct()
    out: dict[str, list[str]] = {}
    for r in lines.select("source", "line").collect():
        out.setdefault(r["source"], []).append(re.escape(r["line"]).replace(r"\#", "#").replace("#", r"\d+"))
    return {s: re.compile(r"\s*(?:" + "|".join(sorted(t)) + r")\s*$") for s, t in out.items()}


EXAMINED = "doc_id bigint, source string, kind string, ended boolean, formula boolean, in_comment boolean, open string, chars int, bytes int"


def examined(docs: DataFrame) -> DataFrame:
    """EXAMINED columns of every document with a text."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(clean_key(F.col("source")), F.lit("")).alias("source"), "text").where("text is not null")
    stamps = _stamps(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = b.column(1).to_pylist()
            got = [examine(t, stamps.get(s)) for t, s in zip(b.column(2).to_pylist(), sources)]
            cols = list(zip(*got)) if got else [()] * 7
            kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[c.split()[0] for c in EXAMINED.split(", ")])

    return named.mapInArrow(run, EXAMINED)


def truncated(docs: DataFrame) -> DataFrame:
    """doc_id, source, kind, reason of documents that were cut off.

    A stack automaton runs over the markup of every text; it must have closed
    whole articles, and pieces must hold nothing and end.  A missing end counts only where
    the feed's own texts of that kind usually have one (BASELINE).  Lines with
    changing numbers that a feed puts below many of its texts are taken off
    first; comments that break off count only where the text has exactly a
    length at which many texts of its feed stop.  Counts cover all documents.
    Null, empty and comment-only texts, notes of withdrawal and whatever follows
    an article's end aren't cases.  Copies each count; source is '' for null.
    """
    e = staged(examined(docs))
    lengths = e.select("source", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("b").alias("unit"), F.col("bytes").alias("length")))).alias("x")).select("source", "x.*")
    counted = lengths.groupBy("source", "unit", "length").count()
    limits = (
        counted.join(counted.groupBy("source", "unit").agg(F.sum("count").alias("all")), ["source", "unit"])
        .where((F.col("length") > 0) & (F.col("count") >= LIMIT_LEAST) & (F.col("count") >= F.col("all") * LIMIT_SHARE))
        .groupBy("source")
        .agg(F.collect_set(F.when(F.col("unit") == "c", F.col("length"))).alias("c"), F.collect_set(F.when(F.col("unit") == "b", F.col("length"))).alias("b"))
    )
    usual = e.groupBy("source", "kind").agg(F.avg(F.col("ended").cast("int")).alias("usual"), F.avg(F.col("formula").cast("int")).alias("formulas"))
    # one row a feed and kind; feeds are few, the optimizer broadcasts them if they fit
    j = e.join(limits, "source", "left").join(usual, ["source", "kind"])
    at_limit = F.coalesce(F.array_contains("c", F.col("chars")) | F.array_contains("b", F.col("bytes")), F.lit(False))
    reason = (
        F.when((F.col("kind") == "file") & ~F.col("ended") & ((F.col("usual") >= BASELINE) | at_limit), "no closing command")
        .when((F.col("kind") == "piece") & ~F.col("ended") & (F.col("open") != ""), "open markup")
        .when(F.col("formula") & (F.col("formulas") >= FORMULA_SHARE) & ~at_limit, None)
        .when((F.col("kind") == "piece") & ~F.col("ended") & ((F.col("usual") >= BASELINE) | at_limit), "no end of sentence")
        .when((F.col("kind") != "file") & F.col("in_comment") & at_limit, "comment cut at the feed's limit")
    )
    return j.withColumn("reason", reason).where("reason is not null").select("doc_id", "source", "kind", "reason")


def truncation_rates(docs: DataFrame) -> DataFrame:
    """source, docs, truncated, rate for every source; '' stands for null."""
    n = docs.select(F.coalesce(clean_key(F.col("source")), F.lit("")).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    cut = truncated(docs).groupBy("source").agg(F.count(F.lit(1)).alias("truncated"))
    return n.join(cut, "source", "left").fillna(0, ["truncated"]).withColumn("rate", F.col("truncated") / F.col("docs"))
