"""Reports as PDF: one binary for each site, laid out on the executors.

A report is a list of lines of kinds; text is broken by the widths of the font's characters, set on pages from
top to bottom and written with a table of the places of all objects, so that any viewer can open it. Characters
that the font lacks are folded to their nearest ones before. A site's findings, actions, questions and
competitors are bounded by the catalogue, so one row holds a report.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.operators import plan as P

#: Widths of the characters from blank to tilde of Helvetica, in thousandths of its size; others are as wide as a digit.
WIDTHS = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
PAGE, MARGIN, LEADING = (595, 842), 56, 1.35
#: Size, boldness, indent and space above of each kind of line.
KINDS = {"title": (20, True, 0, 0), "part": (13, True, 0, 14), "head": (10, True, 0, 7), "text": (9, False, 0, 1), "note": (8, False, 10, 1)}


def width(text: str, size: float, bold: bool = False) -> float:
    # Bold letters are a little wider.
    return sum(WIDTHS[ord(c) - 32] if 32 <= ord(c) < 127 else 556 for c in text) * size / 1000 * (1.08 if bold else 1)


def broken(text: str, size: float, bold: bool, room: float) -> list[str]:
    """Lines no wider than ``room``; a word that is wider is cut."""
    out, line = [], ""
    for word in text.split():
        while width(word, size, bold) > room:
            n = len(word)
            while n > 1 and width(word[:n], size, bold) > room:
                n = n * 9 // 10
            out += [line] * bool(line) + [word[:n]]
            line, word = "", word[n:]
        if line and width(f"{line} {word}", size, bold) > room:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return out + [line] * bool(line)


def pages(lines: list[tuple[str, str]]) -> list[list[tuple[float, float, float, bool, str]]]:
    """(x, y, size, bold, text) of each set line, by pages; a head is never the last line of its page."""
    out, y = [[]], PAGE[1] - MARGIN
    for kind, text in lines:
        size, bold, indent, above = KINDS[kind]
        set_lines = broken(text, size, bold, PAGE[0] - 2 * MARGIN - indent)
        for i, line in enumerate(set_lines):
            step = size * LEADING + (above if i == 0 else 0)
            if y - step - (24 if kind in ("part", "head") else 0) < MARGIN:
                out.append([])
                y = PAGE[1] - MARGIN
            y -= step
            out[-1].append((MARGIN + indent, round(y, 2), size, bold, line))
    return out


def document(lines: list[tuple[str, str]]) -> bytes:
    """The file. Objects: 1 catalogue, 2 page tree, 3 and 4 fonts, then a page and its content by turns."""
    made = pages(lines)
    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(len(made)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(made)} >>".encode()]
    objects += [f"<< /Type /Font /Subtype /Type1 /BaseFont /{name} /Encoding /WinAnsiEncoding >>".encode() for name in ("Helvetica", "Helvetica-Bold")]
    for i, page in enumerate(made):
        body = b"".join(b"BT /F%d %g Tf %g %g Td (%s) Tj ET\n" % (2 if bold else 1, size, x, y, text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("latin-1", "replace")) for x, y, size, bold, text in page)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE[0]} {PAGE[1]}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {6 + 2 * i} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n%sendstream" % (len(body), body))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for number, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, start)
    return bytes(out)


def _listed(rows: DataFrame, order: list[str], line, name: str) -> DataFrame:
    """audit_id and the lines of a part in order."""
    made = rows.select("audit_id", F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], line.alias("lines")).alias("x"))
    return made.groupBy("audit_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["lines"])).alias(name))


def report_lines(t: dict[str, DataFrame]) -> DataFrame:
    """audit_id, host and lines (kind, text) of each site's report, from the tables of an audit."""

    def line(kind: str, *text):
        return F.struct(F.lit(kind).alias("kind"), T.printable(F.concat_ws("", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in text])).alias("text"))

    none = F.array().cast("array<struct<kind:string,text:string>>")
    first = t["overall"].join(t["brands"].select("audit_id", "host", "name"), "audit_id").where(~F.contains("audit_id", F.lit("#"))).join(t["verdicts"], "audit_id", "left")
    top = first.select("audit_id", "host", F.array(line("title", F.coalesce("name", "host")), line("text", F.col("host")), line("part", "Score ", F.col("overall"), " of 100, band ", F.col("band")), line("text", F.coalesce("verdict", F.lit(""))), line("note", F.col("note"))).alias("top"))
    # A pillar without score is shown as not measured.
    shown = F.coalesce(F.col("score").cast("string"), F.lit("not measured"))
    pillars = _listed(t["pillars"], ["pillar"], F.array(line("text", F.upper("pillar"), ": ", shown)), "pillars")
    told = _listed(t["translations"], ["place"], F.array(line("text", F.col("severity"), ": ", F.col("business"))), "told")
    plan = _listed(t["recommendations"].withColumn("_h", F.array_position(F.array(*[F.lit(h) for h in P.LIMITS]), F.col("horizon"))), ["_h", "place"], F.array(line("text", F.col("horizon"), ": ", F.col("check_id"), " (impact ", F.col("impact"), ", effort ", F.col("effort"), ")")), "plan")
    open_ = _listed(t["gaps"].where("NOT answered"), ["rank"], F.array(line("text", F.col("question"))), "open")
    state = F.array_position(F.array(*[F.lit(s) for s in ("fail", "warn", "opportunity", "pass", "not_applicable", "unavailable")]), F.col("status"))
    said = P.evidence_line(F.col("evidence"))
    urls = F.when(F.size("affected_urls") > 0, F.concat(F.lit("Pages: "), F.array_join(F.slice("affected_urls", 1, 5), ", ")))
    lines = F.array(line("head", F.col("title"), ": ", F.col("status")), line("text", F.col("summary")), F.when(said != "", line("note", said)), F.when(urls.isNotNull(), line("note", urls)))
    found = _listed(t["findings"].withColumn("_s", state), ["_s", "check_ord"], F.filter(lines, lambda x: x.isNotNull()), "found")
    rivals = _listed(t["competitors"], ["ord"], F.array(line("text", F.col("host"), ": ", F.coalesce(F.col("overall").cast("string"), F.col("reason"), F.col("status")))), "rivals")
    out = top
    for part in (pillars, told, plan, open_, found, rivals):
        out = out.join(part, "audit_id", "left")
    parts = [F.col("top")]
    for name, title in (("pillars", "Pillars"), ("told", "What it means"), ("plan", "What to do"), ("open", "Questions without an answer"), ("rivals", "Competitors"), ("found", "Findings")):
        parts.append(F.when(F.size(F.coalesce(name, none)) > 0, F.concat(F.array(line("part", title)), F.col(name))).otherwise(none))
    return out.select("audit_id", "host", F.concat(*parts).alias("lines"))


def reports(lines: DataFrame, day: str) -> DataFrame:
    """audit_id, name, pages, pdf of each report; ``day``: its date."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[(x["kind"], x["text"]) for x in found] for found in batch.lines]
            yield pd.DataFrame({"audit_id": batch.audit_id, "host": batch.host, "pages": [len(pages(r)) for r in rows], "pdf": [document(r) for r in rows]})

    made = lines.mapInPandas(run, "audit_id string, host string, pages int, pdf binary")
    return made.select("audit_id", U.report_name(F.col("host"), F.lit(day).cast("date")).alias("name"), "pages", "pdf")
