"""Scalar functions on sequences, qualities and headers, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two Phred alphabets, from their first to last printable letter.
PHRED = {33: "".join(map(chr, range(33, 127))), 64: "".join(map(chr, range(64, 127)))}


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTN", "TGCAN")


def below(quality: Column, offset: int, threshold: int) -> Column:
    """Length of the leading run of qualities under the threshold."""
    top = offset + threshold - 1
    if top < 33:
        return F.lit(0)
    return F.length(F.regexp_extract(quality, rf"\A[\x21-\x{min(top, 126):02x}]*", 0))


def phred_convert(quality: Column, source: Column | int, target: int) -> Column:
    """Quality letters in the target's encoding. 64 to 33: letters from ';' on fall by 31, to '!' at least; others stay.
    33 to 64: letters rise by 31, to '~' at most. Equal offsets: unchanged."""
    down = "".join(map(chr, range(59, 127)))
    to_33 = F.translate(quality, down, "".join(chr(max(33, ord(c) - 31)) for c in down))
    to_64 = F.translate(quality, PHRED[33], "".join(chr(min(126, ord(c) + 31)) for c in PHRED[33]))
    source = F.lit(source) if isinstance(source, int) else source
    return F.when(source == target, quality).otherwise(to_33 if target == 33 else to_64)


def header_base(header: Column) -> Column:
    """The part that mates share: before the first space, or without a trailing /1 or /2."""
    return F.when(F.contains(header, F.lit(" ")), F.substring_index(header, " ", 1)).otherwise(F.regexp_replace(header, r"/[12]\z", ""))


def header_mate(header: Column) -> Column:
    """Read number 1 or 2, or null: from the second field (1:N:0:...), or a trailing /1 or /2."""
    field = F.when(F.contains(header, F.lit(" ")), F.regexp_extract(header, r"\A[^ ]* ([12]):.:", 1)).otherwise(F.regexp_extract(header, r"/([12])\z", 1))
    return F.when(field != "", field.cast("int"))


def mgi_header(header: Column, bc5: str, bc7: str, instrument: str, run: str, valid: Column | None = None) -> Column:
    """An MGI header as an Illumina one; Illumina headers pass. Anything else raises an error where ``valid`` holds."""
    bare = F.regexp_replace(F.regexp_replace(header, r"\A@+", ""), r"\A\s+|\s+\z", "")
    illumina = F.rlike(bare, F.lit(r"\A[\w-]+:\d+:[\w-]+:\d+:\d+:\d+:\d+\s+[12]:[YN]:\d+:"))
    shape = r"\A(\w+)L(\d+)C(\d+)R(\d{3})(\d+)/([12])"

    def part(k: int) -> Column:
        text = F.regexp_extract(bare, shape, k)
        return text if k == 1 else F.regexp_replace(text, r"\A0+(?=\d)", "")

    made = F.concat(
        F.lit(f"@{instrument}:{run}:"), part(1), F.lit(":"), part(2), F.lit(":"), part(5), F.lit(":"), part(3), F.lit(":"), part(4),
        F.lit(" "), part(6), F.lit(f":N:0:{bc7}+{bc5}"),
    )
    out = F.when(illumina, F.concat(F.lit("@"), bare)).when(F.rlike(bare, F.lit(shape)), made)
    bad = F.raise_error(F.concat(F.lit("header is neither MGI nor Illumina: "), header)).cast("string")
    return out.otherwise(bad if valid is None else F.when(valid, bad))


def fastq_record(header: Column, seq: Column, plus: Column, qual: Column) -> Column:
    """Four lines, without the last line's end."""
    return F.concat_ws("\n", header, seq, plus, qual)


def cut_out(text: Column, left: Column, right: Column) -> Column:
    return F.substring(text, left + 1, F.greatest(right - left, F.lit(0)))
