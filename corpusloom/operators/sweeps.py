"""One reading of a text for all spans or quotes that ask for it.

Rows that point into documents are packed into bounded groups per document, so a
text travels once per group and not once per row, and is opened once there. Cutting
spans then costs the text plus the pieces and runs no Python; finding quotes is one
pass of a multi-pattern automaton, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that meet a text together. A document with more of them is read once per such group.
GROUP_ROWS = 20_000

#: Code points of a block of an opened text.
BLOCK = 256


def beside_text(rows: DataFrame, sources: DataFrame, answer: Callable[[Column, Column], Column]) -> DataFrame:
    """``rows`` with an ``answer`` struct that ``answer(text, items)`` gives for all rows of a group at once.

    ``rows`` need ``document_id``; ``sources`` has ``document_id, text``, one row a document. A row without a text
    gets the answer for a null text. Rows move once, by document, and not at all where they are laid out so already:
    they are numbered and packed in that layout.
    """
    columns = [c for c in rows.columns if c != "document_id"]
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("document_id"))
    packed = (
        rows.select("document_id", F.struct(*columns).alias("__item"), F.floor((number - 1) / GROUP_ROWS).alias("__part"))
        .groupBy("document_id", "__part")
        .agg(F.collect_list("__item").alias("__items"))
    )
    opened = packed.join(sources.select("document_id", F.col("text").alias("__text")), "document_id", "left")
    answered = opened.select("document_id", "__items", answer(F.col("__text"), F.col("__items")).alias("__answers"))
    each = answered.select("document_id", F.explode(F.arrays_zip("__items", "__answers")).alias("z")).select("document_id", "z.*")
    return each.select("document_id", *[F.col(f"__items.`{c}`").alias(c) for c in columns], F.col("__answers").alias("answer"))


def _lists(column: pa.Array) -> Iterator[list | None]:
    """Lists of a list column one after another, so that only one row's members are Python objects at a time."""
    members = column.values
    bounds, empty = column.offsets.to_pylist(), column.is_null().to_pylist()
    for i in range(len(column)):
        part = members.slice(bounds[i], bounds[i + 1] - bounds[i])
        if empty[i]:
            yield None
        elif part.null_count and not pa.types.is_string(part.type):
            yield part.to_pylist()  # numbers beside nulls would become floats
        else:
            yield part.to_numpy(zero_copy_only=False).tolist()


def cut_pieces(text: Column, starts: Column, ends: Column, context: int) -> Column:
    """``array<struct(exact, prefix, suffix)>`` of spans given by code points; null where a bound is out of the text.

    A text is opened once, as blocks, and a span reads the blocks it touches. No Python: the rows keep their layout by
    document, so the next step need not move them with their quotes, which are many times the text.
    """

    def cut(opened: Column, a: Column, b: Column) -> Column:
        low = F.greatest(a - context, F.lit(0))
        first = F.floor(low / BLOCK).cast("int")
        touched = F.array_join(F.slice(opened["blocks"], first + 1, F.floor((b + context) / BLOCK).cast("int") - first + 1), "")
        at = (low - first * BLOCK + 1).cast("int")
        inside = (a >= 0) & (a < b) & (b <= opened["n"])
        pieces = F.struct(touched.alias("t"), at.alias("at"), (a - low).cast("int").alias("lead"), (b - a).cast("int").alias("n"))

        def parts(p: Column) -> Column:
            return F.struct(
                F.substring(p["t"], p["at"] + p["lead"], p["n"]).alias("exact"),
                F.substring(p["t"], p["at"], p["lead"]).alias("prefix"),
                F.substring(p["t"], p["at"] + p["lead"] + p["n"], F.lit(context)).alias("suffix"),
            )

        return F.when(inside, F.get(F.transform(F.array(pieces), parts), F.lit(0)))

    # Bound by a lambda each, so that neither the blocks nor a span's piece are made more than once.
    opened = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), F.length(text).alias("n"))
    return F.get(F.transform(F.array(opened), lambda o: F.zip_with(starts, ends, lambda a, b: cut(o, a, b))), F.lit(0))


def _structs(fields: dict[str, pa.Array], key: str, bounds: list[int]) -> pa.Array:
    """Lists of structs; a struct is null where its ``key`` is."""
    structs = pa.StructArray.from_arrays(list(fields.values()), list(fields), mask=fields[key].is_null())
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs)


def find_quotes(text: Column, starts: Column, ends: Column, exact: Column, prefix: Column, suffix: Column) -> Column:
    """``array<struct(start, mode)>``: a quote at its position, else its only occurrence with prefix and suffix.

    Overlapping occurrences count. Null parts, and an empty piece that is not in place, are not found.
    """

    @F.arrow_udf("array<struct<start:long,mode:string>>")
    def find(texts: pa.Array, firsts: pa.Array, lasts: pa.Array, quotes: pa.Array, leads: pa.Array, tails: pa.Array) -> pa.Array:
        import ahocorasick

        def sweep(body: str, pieces: set) -> dict:
            """First start of each piece and whether there is a second one."""
            if not pieces:
                return {}
            machine = ahocorasick.Automaton()
            for piece in pieces:
                machine.add_word(piece, piece)
            machine.make_automaton()
            seen: dict = {}
            for end, piece in machine.iter(body):
                seen[piece] = (end - len(piece) + 1, False) if piece not in seen else (seen[piece][0], True)
            return seen

        start, mode, bounds = [], [], [0]
        for body, *lists in zip(texts, *map(_lists, (firsts, lasts, quotes, leads, tails))):
            body, asked = body.as_py(), list(zip(*lists))
            here = [
                None not in (body, a, b, q) and 0 <= a <= b and body[a:b] == q for a, b, q, _, _ in asked
            ]
            away = [None if h or None in (body, q, p, s) else p + q + s for h, (_, _, q, p, s) in zip(here, asked)]
            seen = sweep(body, {piece for piece in away if piece})
            for h, piece, (a, _, _, p, _) in zip(here, away, asked):
                hit = seen.get(piece)
                found = not h and hit is not None and not hit[1]
                start.append(a if h else hit[0] + len(p) if found else None)
                mode.append("position" if h else "quote_fallback" if found else None)
            bounds.append(len(start))
        return _structs({"start": pa.array(start, pa.int64()), "mode": pa.array(mode, pa.string())}, "start", bounds)

    return find(text, starts, ends, exact, prefix, suffix)
