"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put in another order.

The whole work is SQL of DuckDB, run inside ``mapInArrow``: each slice of a batch is registered as a
table, its texts are cut into units by ``regexp_extract_all``, the parts are lists of units
(``list_slice``) joined again (``array_to_string``), and all random choices come from the
``sha256`` of a salt and the id, so they are the same in any order, partitioning or retry. No row
is handled by Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import slices, trimmed
from codeloom.runtime import ship

#: A unit: a word with the white space before it, or white space at the end. Units make up the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: What stands before each part; a text that holds one of them stays as it is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_DRAWN = """SELECT o, i, t, u, len(u) AS n,
  CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4
FROM (SELECT o, i, t, regexp_extract_all(t, $unit) AS u, sha256($salt || coalesce(CAST(i AS VARCHAR), '')) AS h FROM slice)"""
_FORMED = """SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, $p) OR contains(t, $s) OR contains(t, $m) OR h3 % 100 >= $share THEN 'plain' WHEN h4 % 100 < $spm THEN 'spm' ELSE 'psm' END AS form FROM ({})"""
_PARTS = """SELECT o, i, t, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, a), '') END AS prefix,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, a + 1, b), '') END AS middle, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, b + 1, n), '') END AS suffix FROM ({})"""
_OUTPUT = """SELECT o, i, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
  CASE form WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle WHEN 'spm' THEN $s || suffix || $p || prefix || $m || middle ELSE t END AS output FROM ({})"""
_MADE = _OUTPUT.format(_PARTS.format(_FORMED.format(_DRAWN)))
# the marks stand in a known order and no text that is cut holds one, so the first of each is the one that was put in
_RESTORED = """SELECT *, CASE form
  WHEN 'psm' THEN substr(output, length($p) + 1, instr(output, $s) - length($p) - 1) || substr(output, instr(output, $m) + length($m)) || substr(output, instr(output, $s) + length($s), instr(output, $m) - instr(output, $s) - length($s))
  WHEN 'spm' THEN substr(output, instr(output, $p) + length($p), instr(output, $m) - instr(output, $p) - length($p)) || substr(output, instr(output, $m) + length($m)) || substr(output, length($s) + 1, instr(output, $p) - length($s) - 1)
  ELSE output END AS restored FROM ({})"""


def _connected():
    """DuckDB in memory, with one thread (Spark has the others) and nowhere to spill: no files on an executor's disk."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": "1", "temp_directory": "", "preserve_insertion_order": "true"})


def _by_sql(df: DataFrame, sql: str, values: dict, schema: str, by: str, most: int = 4 << 20) -> DataFrame:
    """``sql`` over each slice of about ``most`` bytes of the column ``by``, which it sees as the table ``slice``; ``o`` is the row's
    place in the slice. Its columns are those of ``schema``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _connected() as db:
            for batch in batches:
                for part in slices(batch, by, most):
                    db.register("slice", pa.Table.from_batches([part]).append_column("o", pa.array(range(part.num_rows), pa.int64())))
                    yield from db.sql(sql, params=values).to_arrow_table().to_batches()
                    db.unregister("slice")

    return df.mapInArrow(trimmed(run), schema)


def fill_in_middle(docs: DataFrame, *, salt: str = "42:", share: int = 50, spm: int = 80, restored: bool = False, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n long, form string, prefix_chars, middle_chars long, output string[, restored string]): each whole text with its
    middle moved to the end, or as it is.

    A text has ``n`` units (:data:`UNIT`). Of the first four 8-digit groups h1 to h4 of the sha256 of ``salt`` and the id, the prefix ends
    after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. ``share`` per cent (h3) are cut, of these
    ``spm`` per cent (h4) to suffix, prefix, middle (``spm``), the others to prefix, suffix, middle (``psm``); a mark stands before each
    part. A text that is empty or holds a mark is ``plain``: ``output`` is the text, and the lengths of the parts, in code points, are null.
    ``restored`` is the text that output and form give. With ``digests``, both are the hex sha256 of their UTF-8.

    Null text is empty. A null id counts as an empty one; ids of any type that has a text form are kept. Bytes that aren't UTF-8 become
    U+FFFD first. Repeated rows repeat; other columns are ignored; no rows give no rows. A slice holds some 4 MB of text or one row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("i"), F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("t"))
    texts = ["output"] + ["restored"] * restored
    out = [f"sha256({c}) AS {c}" if digests else c for c in texts]
    made = _RESTORED.format(_MADE) if restored else _MADE
    sql = f"SELECT i AS doc_id, CAST(n AS BIGINT) AS n, form, CAST(prefix_chars AS BIGINT) AS prefix_chars, CAST(middle_chars AS BIGINT) AS middle_chars, {', '.join(out)} FROM ({made}) ORDER BY o"
    values = {"unit": UNIT, "salt": salt, "p": PREFIX, "s": SUFFIX, "m": MIDDLE, "share": share, "spm": spm}
    return _by_sql(source, sql, values, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, " + ", ".join(f"{c} string" for c in texts), "t")


def restore(formed: DataFrame, *, id_col: str = "doc_id", form_col: str = "form", output_col: str = "output") -> DataFrame:
    """(doc_id, text string): the texts from which ``output_col`` was made, by their forms. Null output gives null."""
    kind = formed.schema[id_col].dataType.simpleString()
    source = formed.select(F.col(id_col).alias("i"), F.col(form_col).alias("form"), F.col(output_col).alias("output"))
    sql = f"SELECT i AS doc_id, restored AS text FROM ({_RESTORED.format('SELECT * FROM slice')}) ORDER BY o"
    return _by_sql(source, sql, {"p": PREFIX, "s": SUFFIX, "m": MIDDLE}, f"doc_id {kind}, text string", "output")
