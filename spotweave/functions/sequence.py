"""Bases, qualities, names and text as column expressions, built-in ones but for `merge_ambiguity`, which steps through letters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spotweave.functions.letters import numbers, points, text

# IUPAC letters by 4na nibble, their complements, the ASCII of 2-bit bases, and phred by log-odds -6..40.
IUPAC = "NACMGRSVTWYHKDBN"
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTMRWSYKVHDBN", "TGCAKYWSRMBDHVN"
BASES = "ACGT"
PHRED = [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7, 8, 9, 10, 10, *range(11, 41)]
BIOLOGICAL, FORWARD, REVERSE = 1, 2, 4


def either(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(bases: Column) -> Column:
    return F.translate(F.reverse(bases), COMPLEMENT_FROM, COMPLEMENT_TO)


def unpack_4na(packed: Column, n: Column | int) -> Column:
    """Two bases a byte, high nibble first; no more than the data holds."""
    return F.substring(F.translate(F.hex(packed), "0123456789ABCDEF", IUPAC), 1, n) if isinstance(n, int) else F.translate(F.hex(packed), "0123456789ABCDEF", IUPAC).substr(F.lit(1), n)


def unpack_2na(packed: Column, n: Column) -> Column:
    """Four bases a byte, highest bits first: a hex digit is a pair of bases."""
    pairs = F.array(*(F.lit(a + b) for a in BASES for b in BASES))
    digits = F.filter(F.split(F.hex(packed), ""), lambda d: d != "")
    return F.array_join(F.transform(digits, lambda d: F.element_at(pairs, F.conv(d, 16, 10).cast("int") + 1)), "").substr(F.lit(1), n)


def nibbles(bases: Column) -> Column:
    """4na of IUPAC letters; N, and letters that are none, have all bits."""
    known = F.create_map(*(x for k, b in enumerate(IUPAC[1:15], 1) for x in (F.lit(b), F.lit(k))))
    return F.transform(F.filter(F.split(bases, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(known, c), F.lit(15)))


NIBBLE = np.full(128, 15, np.uint8)
NIBBLE[[ord(c) for c in IUPAC[1:15]]] = range(1, 15)


def merged_text(bases: pa.Array, mask: pa.Array) -> pa.Array:
    """`merge_ambiguity` over whole arrays."""
    (letters, edges), (bits, marks) = points(bases), numbers(mask)
    row = np.repeat(np.arange(len(bases)), np.diff(edges))
    place = np.arange(len(letters)) - edges[row]
    own = np.append(bits, 0)[np.where(place < np.diff(marks)[row], marks[row] + place, len(bits))]
    merged = NIBBLE[np.minimum(letters, 127)] | own
    if len(merged) and (int(merged.max()) > 15 or int(merged.min()) < 0):
        raise ValueError("a mask beyond four bits")
    absent = bases.is_null().to_numpy(zero_copy_only=False) | mask.is_null().to_numpy(zero_copy_only=False)
    return text(np.frombuffer(IUPAC.encode(), np.uint8)[merged][~absent[row]], np.where(absent, 0, np.diff(edges)), absent)


def merge_ambiguity(bases: Column, mask: Column) -> Column:
    """Bases with the bits of a 4na mask (array<int>, one a base) added; a mask of 0 keeps the base."""
    return F.arrow_udf(merged_text, "string")(bases, mask)


def right_aligned(mask: Column, width: Column) -> Column:
    """A mask trimmed of leading zeros, padded to a width."""
    return F.concat(F.array_repeat(F.lit(0), F.greatest(width - F.size(mask), F.lit(0))), mask)


def log_odds_to_phred(x: Column) -> Column:
    return F.element_at(F.array(*(F.lit(p) for p in PHRED)), (F.greatest(F.lit(-6), F.least(F.lit(40), x)) + 7).cast("int"))


def qual4_to_phred(channels: Column) -> Column:
    """The first of every four log-odds channels, as phred."""
    return F.transform(F.filter(channels, lambda x, i: i % 4 == 0), log_odds_to_phred)


def phred_to_ascii(q: Column) -> Column:
    return F.array_join(F.transform(q, lambda x: F.call_function("char", F.least(x + 33, F.lit(255)).cast("long"))), "")


def lite_quality(length: Column, passed: Column) -> Column:
    return F.call_function("repeat", F.when(passed, "?").otherwise("$"), length.cast("int"))


def raw_quality(q: Column) -> Column:
    """ASCII of raw phred; null (no quality) where it is empty or all zeros."""
    return F.when(F.exists(q, lambda x: x != 0), phred_to_ascii(q))


def has_invalid_quality(q: Column) -> Column:
    return q.rlike("[^!-~]")


def repair_quality(q: Column, n: Column) -> Column:
    """To n characters with '?'; only a quality of the right length has its invalid characters replaced."""
    fitted = F.rpad(q.substr(F.lit(1), n), n, F.lit("?"))
    return F.when(F.length(q) != n, fitted).otherwise(F.regexp_replace(q, "[^!-~]", "?"))


def is_biological(read_type: Column) -> Column:
    return F.coalesce(read_type.bitwiseAND(BIOLOGICAL) == BIOLOGICAL, F.lit(True))


def preview(text: Column, most: int) -> Column:
    """Printable ASCII of the first characters, others as '.', and an ellipsis where it is cut."""
    return F.concat(F.regexp_replace(F.substring(text, 1, most), "[^ -~]", "."), F.when(F.length(text) > most, "…").otherwise(""))


def run_accession(text: Column) -> Column:
    """The accession of a run, upper case; null if it is none."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(text)), r"^([SED]RR\d{6,9})$", 1), F.lit(""))


def accession_kind(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.when(t.rlike(r"^PRJ(NA|EB|DB)\d+$"), "bioproject").when(t.rlike(r"^[SED]RP\d{6,9}$"), "study").when(t.rlike(r"^[SED]RR\d{6,9}$"), "run").otherwise("invalid")


def ftp_to_https(url: Column) -> Column:
    return F.when(url.startswith("ftp://"), F.concat(F.lit("https://"), url.substr(F.lit(7), F.length(url)))).when(url.startswith("https://") | url.startswith("http://"), url).otherwise(F.concat(F.lit("https://"), url))


def split_or_empty(text: Column, by: str = ";") -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, by))


def has_suffix(url: Column, suffix: str) -> Column:
    return F.endswith(F.split_part(url, F.lit("?"), F.lit(1)), F.lit(suffix))


def assign_slots(urls: Column) -> Column:
    """Slots of a run's files by their names; a bare name is an orphan only beside both mates."""
    one, two = (lambda u, k=k: has_suffix(u, f"_{k}.fastq.gz") for k in (1, 2))
    paired = F.exists(urls, lambda u: one(u)) & F.exists(urls, lambda u: two(u))
    return F.transform(urls, lambda u: F.when(one(u), "read1").when(two(u), "read2").when(paired, "unpaired").otherwise("single"))


def _fixed(x: Column, digits: int) -> Column:
    """A number of at least 1 with so many decimals, exact ties to even.  The part after the point is exact on its own,
    and its digits tell a tie from a number next to one."""
    return F.format_string(f"%.{digits}f", F.floor(x) + F.bround(x - F.floor(x), digits))


def _scaled(n: Column, steps: list[tuple[int, str, int]], least: Column) -> Column:
    out = least
    for size, unit, digits in steps:
        out = F.when(n >= size, F.concat(_fixed(n / F.lit(float(size)), digits), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_size(n: Column) -> Column:
    steps = [(1 << 10, "KiB", 2), (1 << 20, "MiB", 2), (1 << 30, "GiB", 2), (1 << 40, "TiB", 2)]
    return _scaled(n, steps, F.format_string("%d B", n))


def format_bases(n: Column) -> Column:
    return _scaled(n, [(10**3, "Kbp", 1), (10**6, "Mbp", 2), (10**9, "Gbp", 2)], F.format_string("%d bp", n))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def shown_year(time: Column) -> Column:
    """A year as SQL shows it: four digits, without a sign beyond 9999; before year 0 not padded."""
    year = F.year(time)
    return F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))


def iso_time(epoch: Column) -> Column:
    time = F.timestamp_seconds(epoch)
    return F.concat(shown_year(time), F.date_format(time, "-MM-dd HH:mm:ss"))


def c_time(epoch: Column) -> Column:
    time = F.timestamp_seconds(epoch)
    return F.concat(F.date_format(time, "MM/dd/"), shown_year(time), F.date_format(time, " HH:mm"))


def now_utc() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fastq_bytes(spots: Column, lengths: Column, compressed: bool = False) -> Column:
    """An estimate of a run's FASTQ: 40 + 2 a record besides its bases and qualities."""
    plain = spots * F.aggregate(lengths, F.lit(0).cast("bigint"), lambda s, n: s + 42 + 2 * n)
    return F.floor(plain / 5).cast("bigint") if compressed else plain


def bits(value: Column, n: int) -> Column:
    """The lowest n bits of a number, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(value, i).cast("int"))


def unpacked(words: Column, packed_bits: int) -> Column:
    """The packed_bits-bit numbers of an array of bytes, highest bits first (widths that divide eight)."""
    per = 8 // packed_bits
    mask = (1 << packed_bits) - 1
    return F.flatten(F.transform(words, lambda b: F.array(*(F.shiftright(b, 8 - packed_bits * (k + 1)).bitwiseAND(F.lit(mask)) for k in range(per)))))


def field_csv(text: Column, delimiter: str = ",") -> Column:
    """A field in quotes where it has the delimiter, a quote or a line end; quotes doubled."""
    special = '[\\x22\\r\\n' + ("\\t" if delimiter == "\t" else delimiter) + "]"
    return F.when(text.rlike(special), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
