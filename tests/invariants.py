"""Plain versions of the registered queries that SQL cannot express. Each takes (spark, sf_dir, columns,
rows) and returns what is wrong, or an empty string."""
import hashlib
import html
import itertools
import re
from collections import Counter

import regex
from pyspark.sql import functions as F


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def html_blocks(spark, sf_dir, columns, rows):
    """Headings and paragraphs of the flat pages, read with patterns: a heading is h1 to h6, a paragraph
    the text from <p> to the next tag that is not inline."""
    from termflow.functions import text as T
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    found = []
    for page_id, page in pages:
        body = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", page)
        for kind, text in re.findall(r"(?s)<(h1|p)>(.*?)(?=<p>|</p>|</h1>|</article>|<footer>)", body):
            # an open <b> takes the next <p> into itself, so only paragraphs without one are compared
            if "<b>" not in text:
                words = " ".join(x.strip() for x in re.split(r"<[^>]*>", html.unescape(text)) if x.strip())
                found.append((page_id, "heading" if kind == "h1" else "paragraph", words))
    keep = spark.createDataFrame(found, "page_id long, type string, t string").where(T.is_translatable(F.col("t")))
    want = Counter((r.page_id, r.type, md5(r.t)) for r in keep.collect())
    at = {c: i for i, c in enumerate(columns)}
    got = Counter((r[at["page_id"]], r[at["type"]], r[at["source"]]) for r in rows)
    lost = want - got
    return f"lost {list(lost)[:3]} of {sum(want.values())}" if lost else ""


def segments_by_type(spark, sf_dir, columns, rows):
    """The rule of every file type run on its own."""
    from termflow.functions import constants as K
    from termflow.operators import segments as S
    from termflow.plans.segment_queries import with_blocks
    types = ("pptx", "srt", "json", "docx", "md", "odt")
    want = {}
    for i, kind in enumerate(types):
        own = with_blocks(spark, sf_dir).where(F.col("doc_id") % 6 == i)
        cut = S.segment(own, S.RULE_BY_TYPE.get(kind, "general"), K.SEGMENT_TOKENS.get(kind, K.SEGMENT_TOKENS["default"]))
        want[kind] = tuple(cut.agg(F.sum(F.size("segments")), F.sum(F.size("blocks"))).first())
    at = {c: i for i, c in enumerate(columns)}
    got = {r[at["file_type"]]: (r[at["n_segments"]], r[at["n_blocks"]]) for r in rows}
    return "" if got == want else f"{got} instead of {want}"


def rebuilt_markdown(spark, sf_dir, columns, rows):
    """Blocks written back unchanged give the file; changed ones can be read again from the new file."""
    from termflow.plans.source_queries import md_files
    from termflow.sources import plain as P
    files = md_files(spark, sf_dir)
    blocks = P.md_blocks(files)
    same = P.rebuild_lines(files, blocks.withColumn("best_text", F.col("source_text")), markdown=True)
    lines = lambda t: re.split(r"\r\n|\r|\n", t)
    before = {r.doc_id: lines(r.text) for r in files.collect()}
    if any(lines(r.text) != before[r.doc_id] for r in same.collect()):
        return "an unchanged file differs"
    new = P.rebuild_lines(files, blocks.withColumn("best_text", F.concat(F.lit("[T]"), "source_text")), markdown=True)
    got = {r[columns.index("doc_id")]: r[columns.index("content")] for r in rows}
    if {r.doc_id: md5(r.text) for r in new.collect()} != got:
        return "contents differ"
    texts = lambda b: Counter(r.t for r in b.select("doc_id", "type", "source_text").select(F.concat_ws("|", "doc_id", "type", "source_text").alias("t")).collect())
    marked = blocks.withColumn("source_text", F.concat(F.lit("[T]"), "source_text"))
    lost = texts(marked) - texts(P.md_blocks(new))
    return f"lost {list(lost)[:2]}" if lost else ""


def asr_pruned_terms(spark, sf_dir, columns, rows):
    """The pruning rule walked term by term."""
    from termflow.functions import constants as K
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()

    def close(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    want = Counter()
    for doc_id, text in docs:
        counts = Counter(regex.findall(K.ACRONYM, text or ""))
        short = [t for t in sorted(counts) if len(t) <= 4]
        dropped, skipped, at_first = set(), set(), None
        for first, second in itertools.combinations(short, 2):
            if first != at_first:  # what was dropped before its own turn drops nothing more
                at_first, skipped = first, set(dropped)
            if second not in dropped and first not in skipped and close(first, second):
                dropped.add(second if counts[first] >= counts[second] else first)
        want.update((doc_id, t) for t in counts if t not in dropped)
    at = {c: i for i, c in enumerate(columns)}
    got = Counter((r[at["doc_id"]], r[at["source"]]) for r in rows)
    return "" if got == want else f"more {list(got - want)[:3]}, less {list(want - got)[:3]}"


INVARIANTS = {f.__name__: f for f in (html_blocks, segments_by_type, rebuilt_markdown, asr_pruned_terms)}
