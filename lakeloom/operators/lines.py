"""Operators on the lines of documents: headings around a line, sections, numbering, cuts, budgets.

Lines come as (doc columns..., line_no from 1, line). Everything is a window by document, so documents run in parallel;
a greedy choice that no window can state is a fold over one document's lines.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lakeloom.operators.cut import saved
from lakeloom.functions import text as T

HEADING = r"^(#{1,6})\s+(.+)$"


def explode(docs: DataFrame, text_col: str, most: int | None = None) -> DataFrame:
    """Documents -> lines; the first `most` only if given."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    lines = lines if most is None else F.slice(lines, 1, most)
    return docs.select(*[c for c in docs.columns if c != text_col], F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def first_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def is_heading(line: Column) -> Column:
    return F.trim(line).rlike(HEADING)


def clean_heading(line: Column) -> Column:
    """Level marks and text without URL; null for other lines."""
    text = T.strip_heading_url(F.regexp_extract(F.trim(line), HEADING, 2))
    return F.when(is_heading(line) & (text != ""), F.concat(F.regexp_extract(F.trim(line), HEADING, 1), F.lit(" "), text))


def with_heading_above(lines: DataFrame, by: list[str], within: int = 100) -> DataFrame:
    """`heading`: the nearest at or above the line, at most `within` lines back; a page's first line is never one."""
    w = Window.partitionBy(*by).orderBy("line_no").rowsBetween(-(within - 1), 0)
    return lines.withColumn("heading", F.last(F.when(F.col("line_no") > 1, clean_heading(F.col("line"))), ignorenulls=True).over(w))


def with_section_bounds(lines: DataFrame, by: list[str]) -> DataFrame:
    """`section_from` and `section_to`: the lines around a line between the heading before and the heading after it."""
    w = Window.partitionBy(*by).orderBy("line_no")
    mark = F.when(is_heading(F.col("line")), F.col("line_no"))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy(*by).orderBy(F.desc("line_no"))  # a frame to the end of the page would be read anew for each row
    after = F.last(mark, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    end = F.max("line_no").over(Window.partitionBy(*by))
    return lines.withColumns({"section_from": F.coalesce(before + 1, F.lit(1)), "section_to": F.coalesce(after - 1, end)})


def with_section_end(headings: DataFrame, by: list[str], *, no: str = "line_no", level: str = "level") -> DataFrame:
    """`section_end`: the number of the next heading of the same level or above, null for the last of its page. One pass from
    the end of a page, which keeps the nearest heading of each level; the levels that there are, a handful, are asked first."""
    levels = sorted(r[0] for r in headings.where(F.col(level).isNotNull()).select(level).distinct().collect())
    back = Window.partitionBy(*by).orderBy(F.desc(no)).rowsBetween(Window.unboundedPreceding, -1)
    nearest = [F.when(F.col(level) == v, F.last(F.when(F.col(level) <= v, F.col(no)), ignorenulls=True).over(back)) for v in levels]
    return headings.withColumn("section_end", F.coalesce(*nearest) if nearest else F.lit(None).cast("long"))


def sections(lines: DataFrame, by: list[str], wanted: DataFrame, block: int = 256) -> DataFrame:
    """wanted (by..., title) -> the lines from the first heading of that title to the next of its level or above, with title.

    A title matches with or without number and URL, in any case. Lines meet only sections that have a line of their block.
    """
    head = lines.where(F.col("line").rlike(r"^(#+)\s+")).withColumn("level", F.length(F.regexp_extract("line", r"^(#+)\s+", 1)))
    bare = lambda c: F.lower(T.core_title(c))
    text = F.regexp_replace(F.col("line"), r"^#+\s+", "")
    asked = wanted.select(*by, "title").distinct()
    ended = with_section_end(head, by).withColumn("__core", bare(text))
    matched = ended.join(asked.withColumn("__core", bare(F.col("title"))), [*by, "__core"])
    start = matched.groupBy(*by, "title").agg(F.min(F.struct("line_no", "section_end")).alias("s")).select(*by, "title", F.col("s.line_no").alias("__from"), F.col("s.section_end").alias("__end"))
    last = lines.groupBy(*by).agg(F.max("line_no").alias("__last"))
    span = start.join(last, by).select(*by, "title", "__from", F.coalesce("__end", F.col("__last") + 1).alias("__to"))
    blocks = F.sequence(F.floor(F.col("__from") / block), F.floor((F.col("__to") - 1) / block))
    met = lines.withColumn("__block", F.floor(F.col("line_no") / block)).join(span.withColumn("__block", F.explode(blocks)), [*by, "__block"])
    return met.where((F.col("line_no") >= F.col("__from")) & (F.col("line_no") < F.col("__to"))).drop("__from", "__to", "__block")


def numbered(anchors: DataFrame, by: list[str], level: str = "level", order: str = "pos") -> DataFrame:
    """`number` such as 1.2.1 of levels 1 to 4: running counts, each level's within the counts of those above."""
    out, group = anchors, list(by)
    names = []
    for k in range(1, 5):
        w = Window.partitionBy(*group).orderBy(order)
        out = out.withColumn(f"__c{k}", F.sum((F.col(level) == k).cast("int")).over(w))
        group.append(f"__c{k}")
        names.append(F.when(F.col(level) >= k, F.col(f"__c{k}").cast("string")))
    return out.withColumn("number", F.concat_ws(".", *names)).drop("__c1", "__c2", "__c3", "__c4")


def mark_pattern(marks: list[str], markdown: bool = True) -> str:
    start = r"^(##+\s*)?(?:\d+\.\s*)?" if markdown else r"^\s*"
    return start + "(?:" + "|".join(r"\s+".join(map(re.escape, m.split())) for m in marks) + ")"


def cut_at_mark(lines: DataFrame, by: list[str], marks: list[str], markdown: bool = True) -> DataFrame:
    """The lines before the first that begins with an end mark (plain text, its blanks any blanks, its own case)."""
    first = F.min(F.when(F.col("line").rlike(mark_pattern(marks, markdown)), F.col("line_no"))).over(Window.partitionBy(*by))
    return lines.withColumn("__cut", first).where(F.col("__cut").isNull() | (F.col("line_no") < F.col("__cut"))).drop("__cut")


def toc(lines: DataFrame, sql: bool = False) -> DataFrame:
    """Heading lines as level, text, anchor and slug: link texts alone, the URL after the last colon as the anchor. sql: lines end and
    blanks are told as SQL has it, which makes a difference for returns and for blanks that are not of ASCII."""
    read, trim = (T.re2, T.trim) if sql else (str, F.trim)
    line, heading, ref = trim(F.col("line")), read(HEADING), read(T.ANCHOR)
    full = trim(F.regexp_extract(line, heading, 2))
    anchor = F.regexp_extract(full, ref, 0)
    text = trim(F.regexp_replace(full, ref, ""))
    link = F.regexp_extract(text, r"\[([^\]]+)\]\([^)]+\)", 1)
    return lines.where(line.rlike(heading)).withColumns({
        "level": F.length(F.regexp_extract(line, heading, 1)),
        "text": F.when(link != "", link).otherwise(text),
        "anchor": F.when(anchor != "", F.regexp_replace(anchor, "^(：|: )", "")),
        "slug": T.slug(full, sql),
    })


def lowest_level_only(headings: DataFrame, by: list[str]) -> DataFrame:
    """Each page's headings of the level nearest the top."""
    return headings.withColumn("__least", F.min("level").over(Window.partitionBy(*by))).where(F.col("level") == F.col("__least")).drop("__least")


def up_to_level(headings: DataFrame, most: int) -> DataFrame:
    return headings.where(F.coalesce("level", F.lit(6)) <= most)


def line_counts(docs: DataFrame, by: list[str], text_col: str, threshold: int = 2100) -> DataFrame:
    """Lines of each item, of its group, and whether the group is over the threshold. Sums by group are joined back, so that
    no group meets in one task; groups are told apart as they are, null ones too."""
    rows = docs.withColumn("lines", F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")))
    if not by:
        total = rows.agg(F.sum("lines").alias("total_lines"))
        return rows.crossJoin(F.broadcast(total)).withColumn("over", F.col("total_lines") > threshold)  # total is one row
    total = rows.groupBy(*by).agg(F.sum("lines").alias("total_lines")).select(*[F.col(c).alias(f"__{c}") for c in by], "total_lines")
    same = [rows[c].eqNullSafe(total[f"__{c}"]) for c in by]
    return rows.join(total, same).drop(*[f"__{c}" for c in by]).withColumn("over", F.col("total_lines") > threshold)


def packed(items: DataFrame, by: list[str], order: list, size: str, budget: float, fold_rows: int = 2_000) -> DataFrame:
    """`taken`: whether an item fits into the group's budget, in the given order; what does not fit is passed over and
    costs nothing, but the first is always taken. Sizes are whole numbers from 0 on, and a null size is 0.

    Where all groups have `fold_rows` rows at most, their sizes are folded; beyond that no group meets in a row or a task:
    packed_by_rounds() gives the same.
    """
    rows = items.withColumn("__size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > fold_rows:
        return packed_by_rounds(rows, by, order, budget)
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("__pos", pos)
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("__pos", F.col("__size").alias("s")))),
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("took")),
        lambda acc, x: F.when((acc["used"] + x["s"] <= budget) | (F.size(acc["took"]) == 0), F.struct((acc["used"] + x["s"]).alias("used"), F.concat(acc["took"], F.array(x["__pos"])).alias("took"))).otherwise(acc),
        lambda acc: acc["took"],
    )
    keys = [f"__k{i}" for i in range(len(by))]
    took = rows.groupBy(*by).agg(fold.alias("__took")).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.explode("__took").alias("__at"), F.lit(True).alias("__in"))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)] + [F.col("__pos") == F.col("__at")]
    return rows.join(took, same, "left").select(*items.columns, F.coalesce("__in", F.lit(False)).alias("taken"))


def packed_by_rounds(rows: DataFrame, by: list[str], order: list, budget: float) -> DataFrame:
    """packed() of rows with `__size`, by distributed prefix sums.

    The rows are dealt by ranges of group and order, each range a part of bounded size. A round sums up the sizes within each
    part and adds what the group's earlier parts hold: the longest prefix that fits is taken, and all that is larger than
    what is then left can never be and goes, the row at which the prefix ended among it. The rest, which is smaller and
    smaller, meets the next round; each takes at least one row of every group that has any left.
    """
    group = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k{i}") for i, c in enumerate(by)], *[F.col(c).isNull().alias(f"n{i}") for i, c in enumerate(by)])
    dealt = rows.withColumn("__g", group).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    base = saved(dealt.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))  # row numbers follow the order
    left, first, taken = base.select("__g", "__part", "__row", "__size").withColumn("__left", F.lit(budget).cast("double")), True, None
    while True:
        parts = left.groupBy("__g", "__part").agg(F.sum("__size").alias("s"), F.count("*").alias("c"))
        earlier = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = saved(parts.select("__g", "__part", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"__{x}") for x in ("s", "c")]))
        within = Window.partitionBy("__g", "__part").orderBy("__row")
        run = left.join(parts, ["__g", "__part"]).withColumns({"__sum": F.col("__s") + F.sum("__size").over(within), "__pos": F.col("__c") + F.row_number().over(within)})
        fits = F.col("__sum") <= F.col("__left")
        run = saved(run.withColumn("__in", fits | (F.col("__pos") == 1) if first else fits).select("__g", "__part", "__row", "__size", "__left", "__in"))
        own = run.where("__in").select("__row")
        taken = own if taken is None else taken.unionByName(own)
        used = saved(run.where("__in").groupBy("__g").agg(F.sum("__size").alias("__used")))
        rest = run.where("not __in").join(used, "__g").withColumn("__left", F.col("__left") - F.col("__used"))
        left, first = saved(rest.where(F.col("__size") <= F.col("__left")).select("__g", "__part", "__row", "__size", "__left")), False
        if left.isEmpty():
            break
    names = [c for c in rows.columns if c != "__size"]
    return base.join(taken.withColumn("__in", F.lit(True)), "__row", "left").select(*names, F.coalesce("__in", F.lit(False)).alias("taken"))


def truncated(text: str, threshold: int) -> str:
    """Code blocks and headings whole, other lines while there is room, no two blank lines; then a note of what is missing."""
    lines = text.split("\n")
    if len(lines) <= threshold:
        return text
    out, count, fenced = [], 0, False
    for line in lines:
        fence = line.strip().startswith("```")
        if not (fence or fenced or line.strip().startswith("#")):
            if count >= threshold or not line.strip() and out and not out[-1].strip():
                continue
        fenced ^= fence
        out.append(line)
        count += 1
    if len(lines) > count:
        out.append(f"\n\n... ({len(lines) - count} more lines truncated)")
    return "\n".join(out)


def smart_truncate(text: Column, threshold: int = 2100) -> Column:
    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else truncated(t, threshold))

    return run(text)


_URLS = [(re.compile(f"(?{flags}){pattern}" if flags else pattern), new) for pattern, flags, new in T.URL_PARTS]


def plain(text: str) -> str:
    for pattern, new in _URLS:
        text = pattern.sub(new, text)
    return text.strip()


def size_of(text: str) -> int:
    clean = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", text)).strip()
    if re.search(T.CJK_RE, clean):
        return len(re.findall(T.CJK_RE, clean)) + len(re.findall(r"\b[a-zA-Z]+\b", clean))
    return len(clean.split())


def grown(lines: list[str], at: int, most: int = 100) -> str:
    """The section's lines around line `at` (from 0) that fit into `most` words: the line itself, then to the left while
    it fits, then to the right; headings are left out, rules stripped."""
    is_head = lambda i: bool(re.match(r"#{1,6}\s+", lines[i].strip()))
    top = next((i + 1 for i in range(at - 1, -1, -1) if is_head(i)), 0)
    end = next((i for i in range(at + 1, len(lines)) if is_head(i)), len(lines))
    own = [(i, re.sub(r"^---+\s*", "", lines[i].strip())) for i in range(top, end) if not is_head(i)]
    own = [(i, s) for i, s in own if s]
    if not own:
        return ""
    whole = plain("\n".join(s for _, s in own))
    if size_of(whole) <= most:
        return whole
    a = b = next((k for k, (i, _) in enumerate(own) if i == at), 0)
    used = size_of(plain(own[a][1]))
    if used > most:
        return " ".join(own[a][1].split()[:most])
    while True:
        if a > 0 and used + (n := size_of(plain(own[a - 1][1]))) <= most:
            a -= 1
        elif b + 1 < len(own) and used + (n := size_of(plain(own[b + 1][1]))) <= most:
            b += 1
        else:
            return "\n".join(s for _, s in own[a : b + 1])
        used += n


def symmetric(lines: list[str], most: int) -> str:
    """Lines cut to `most` words from both ends in turn: the first goes where the ends' numbers add up to an even one, else
    the last; one line that is still too long loses its last words."""
    a, b = 0, len(lines) - 1
    while a < b and size_of("\n".join(lines[a : b + 1])) > most:
        a, b = (a + 1, b) if (a + b) % 2 == 0 else (a, b - 1)
    text = "\n".join(lines[a : b + 1])
    words = text.split()
    return " ".join(words[:most]) if size_of(text) > most and len(words) > most else text


def symmetric_cut(text: Column, most: int = 100) -> Column:
    """A text's lines, headings left out, cut by symmetric(); null stays null."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else symmetric([x for x in t.split("\n") if not re.match(r"#{1,6}\s+", x.strip())], most))

    return run(text)


def context(text: Column, line_no: Column, most: int = 100) -> Column:
    """The context of a line (from 1) of a text."""

    @pandas_udf("string")
    def run(texts: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([grown((t or "").split("\n"), int(i) - 1, most) if t is not None and 1 <= i <= t.count("\n") + 1 else "" for t, i in zip(texts, at)], dtype=object)

    return run(text, line_no)
