"""Fill-in-middle transformation: DuckDB SQL over Arrow batches, no Python code for a row.

Each task opens one in-process DuckDB connection. A batch is cut by bytes, registered as
a table, and one statement hashes the ids, cuts the texts into units and puts the parts
together; Arrow comes back. Units (code points, or words with the space after them) are
found by ``regexp_extract_all`` in blocks of ``BLOCK`` units, and single ones only in the
blocks where a part begins or ends, so lists stay a hundred times shorter than texts.

Null texts are empty ones. A null doc_id counts as one without digits. Rows do not touch
each other: repeated rows give equal results, and an empty table gives an empty one. A text of any
length is one value; memory is bounded by a slice of a batch, or by one longer text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from factgraph.llm.common import byte_slices, texts

#: Patterns whose matches, left to right, make up any text.
UNITS = {"char": "(?s:.)", "word": r"(?:\S+\s*|\s+)"}
BLOCK = 100
SCHEMA = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"

MACROS = """
CREATE MACRO units(block) AS regexp_extract_all(coalesce(block, ''), '{unit}');
CREATE MACRO head(blocks, k) AS array_to_string(list_slice(blocks, 1, k // {block}), '') || array_to_string(list_slice(units(blocks[k // {block} + 1]), 1, k % {block}), '');
CREATE MACRO tail(blocks, k) AS array_to_string(list_slice(units(blocks[k // {block} + 1]), k % {block} + 1, {block}), '') || array_to_string(list_slice(blocks, k // {block} + 2, len(blocks)), '');
CREATE MACRO number(hash, k) AS CAST('0x' || substr(hash, 8 * k - 7, 8) AS BIGINT);
"""

CUT = """
WITH hashed AS (
  SELECT doc_id, text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash, regexp_extract_all(text, '{unit}{{1,{block}}}') AS blocks FROM batch
), counted AS (
  SELECT *, CASE WHEN len(blocks) = 0 THEN 0 ELSE (len(blocks) - 1) * {block} + len(units(blocks[len(blocks)])) END AS n FROM hashed
), dealt AS (
  SELECT *, least(number(hash, 1) % (n + 1), number(hash, 2) % (n + 1)) AS a, greatest(number(hash, 1) % (n + 1), number(hash, 2) % (n + 1)) AS z,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR number(hash, 3) % 100 >= {formatted} THEN 'plain'
         WHEN number(hash, 4) % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
  FROM counted
), parted AS (
  SELECT *, head(blocks, a) AS prefix, tail(blocks, z) AS suffix,
    CASE WHEN a // {block} = z // {block} THEN array_to_string(list_slice(units(blocks[a // {block} + 1]), a % {block} + 1, z % {block}), '')
         ELSE tail(list_slice(blocks, 1, z // {block}), a) || array_to_string(list_slice(units(blocks[z // {block} + 1]), 1, z % {block}), '') END AS middle
  FROM dealt WHERE form <> 'plain'
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(a AS BIGINT) AS prefix_units, CAST(z - a AS BIGINT) AS middle_units,
  CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parted
UNION ALL SELECT doc_id, CAST(n AS BIGINT), form, NULL, NULL, text FROM dealt WHERE form = 'plain'
"""

# A mark cannot begin inside another one, so the first that is met is the one that was set.
RESTORE = """
WITH marked AS (
  SELECT *, CASE form WHEN 'psm' THEN strpos(output, '<S>') WHEN 'spm' THEN strpos(output, '<P>') END AS second, strpos(output, '<M>') AS third FROM batch
), parts AS (
  SELECT *, substr(output, 4, second - 4) AS one, substr(output, second + 3, third - second - 3) AS two, substr(output, third + 3) AS three FROM marked
)
SELECT * EXCLUDE (second, third, one, two, three), CASE form WHEN 'psm' THEN one || three || two WHEN 'spm' THEN two || three || one ELSE output END AS text FROM parts
"""


def _through_duckdb(df: DataFrame, setup: str, sql: str, schema: str, measured: str) -> DataFrame:
    """``df`` with a DuckDB statement over the table ``batch`` applied to every slice of every Arrow batch."""
    at = df.columns.index(measured)

    def run(batches):
        import duckdb

        with duckdb.connect(config={"threads": 1}) as db:
            if setup:
                db.execute(setup)
            for whole in batches:
                for part in byte_slices(whole, at):
                    db.register("batch", pa.Table.from_batches([part]))
                    yield from db.sql(sql).to_arrow_table().to_batches()
                    db.unregister("batch")

    return df.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: int = 1, formatted: int = 90, spm: int = 20) -> DataFrame:
    """doc_id, n (units of the text), form, prefix_units, middle_units, output for each row.

    ``formatted`` of a hundred documents are cut, ``spm`` of a hundred of those suffix
    first; both, and the two cuts, follow from sha256 of ``seed`` and doc_id. Empty texts
    and those that hold a mark already stay plain, with null part sizes.
    """
    keep = {"unit": UNITS[unit], "block": BLOCK, "seed": int(seed), "formatted": int(formatted), "spm": int(spm)}
    return _through_duckdb(texts(docs), MACROS.format(**keep), CUT.format(**keep), SCHEMA, "text")


def restore(formatted: DataFrame) -> DataFrame:
    """What fill_in_middle returns, with the text rebuilt from output and form alone."""
    return _through_duckdb(formatted.select("doc_id", "n", "form", "prefix_units", "middle_units", "output"), "", RESTORE, SCHEMA + ", text string", "output")
