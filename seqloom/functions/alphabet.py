"""Alphabets as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for every wildcard after mapping; it never equals anything, itself included.
WILDCARD = "#"


@dataclass(frozen=True)
class SymbolMap:
    """Classes of symbols, each with the symbol that stands for it, and wildcards."""

    classes: tuple[tuple[str, str], ...]
    wildcards: str = ""

    @classmethod
    def parse(cls, text: str) -> SymbolMap:
        """A map file: one line for each class (symbols, then the one to show, which may be left out), the last for wildcards."""
        lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
        rows = [x.split() for x in lines]
        if len(rows) < 2:
            raise ValueError("a symbol map needs a line of symbols and a line of wildcards")
        return cls(tuple((r[0], r[1][0] if len(r) > 1 else r[0][0]) for r in rows[:-1]), rows[-1][0])

    @classmethod
    def inferred(cls, symbols: str) -> SymbolMap:
        """Each symbol a class of its own, by code."""
        return cls(tuple((c, c) for c in sorted(set(symbols))))

    @property
    def size(self) -> int:
        """Classes with the wildcard as one."""
        return len(self.classes) + 1

    def pairs(self) -> tuple[str, str]:
        source = "".join(c for c, _ in self.classes) + self.wildcards
        return source, "".join(show * len(c) for c, show in self.classes) + WILDCARD * len(self.wildcards)

    def apply(self, seq: Column, strict: bool = True) -> Column:
        """The sequence with every symbol as its class; another symbol is an error, or a wildcard if not strict."""
        source, target = self.pairs()
        other = F.length(F.translate(seq, source, "")) > 0
        if strict:
            return F.when(other, F.raise_error(F.concat(F.lit("symbols outside the alphabet: "), F.translate(seq, source, "")))).otherwise(F.translate(seq, source, target))
        # what the map lacks is marked first, by keeping only its symbols
        escaped = "".join(f"\\x{{{ord(c):x}}}" for c in source)
        return F.translate(F.regexp_replace(seq, f"[^{escaped}]", WILDCARD), source, target)


#: Built-in alphabets. Fixed values.
DNA = SymbolMap((("aA", "a"), ("cC", "c"), ("gG", "g"), ("tTuU", "t")), "nsywrkvbdhmNSYWRKVBDHM")
PROTEIN = SymbolMap(tuple((c, c) for c in "LVIFKREDAGSTNQYWPHMC"), "XUBZJO*-")
#: Amino acids in eleven groups of like ones. Fixed values.
PROTEIN11 = SymbolMap((("AGST", "A"), ("NQ", "N"), ("DE", "D"), ("KR", "K"), ("LIVM", "L"), ("F", "F"), ("Y", "Y"), ("W", "W"), ("H", "H"), ("P", "P"), ("C", "C")), "XUBZJO*-")


def complement(seq: Column) -> Column:
    return F.translate(seq, "acgtACGT", "tgcaTGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def packed(seq: Column) -> Column:
    """A DNA sequence in two bits for each base, as hexadecimal digits of two bases each, the last one filled with a."""
    two = F.create_map(*[F.lit(x) for i, p in enumerate(x + y for x in "acgt" for y in "acgt") for x in (p, "0123456789abcdef"[i])])
    whole = F.when(F.length(seq) % 2 == 1, F.concat(seq, F.lit("a"))).otherwise(seq)
    return F.array_join(F.transform(F.regexp_extract_all(whole, F.lit("[acgt]{2}"), F.lit(0)), lambda p: two[p]), "")


def unpacked(code: Column, n: Column) -> Column:
    """The first n bases of a packed sequence."""
    two = F.create_map(*[F.lit(x) for i, p in enumerate(x + y for x in "acgt" for y in "acgt") for x in ("0123456789abcdef"[i], p)])
    return F.left(F.array_join(F.transform(F.split(code, ""), lambda d: F.coalesce(two[d], F.lit(""))), ""), n)


def kmer_code(kmer: Column, symbols: str = "acgt") -> Column:
    """The k-mer as a number to the base of the alphabet's size, of 36 symbols at most."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[: len(symbols)]
    return F.conv(F.translate(kmer, symbols, digits), len(symbols), 10).cast("long")


def kmer_text(code: Column, k: int, symbols: str = "acgt") -> Column:
    """The k-mer of a number."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[: len(symbols)]
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, len(symbols)), k, "0"), digits, symbols)


def all_strings(spark: SparkSession, symbols: str, n: int) -> DataFrame:
    """All strings of n symbols, numbered by their code; the number is the alphabet's size to the power n."""
    base = len(symbols)
    digit = lambda i: F.substr(F.lit(symbols), (F.floor(F.col("id") / base ** (n - 1 - i)) % base + 1).cast("int"), F.lit(1))
    return spark.range(base**n).select(F.col("id").alias("code"), F.concat(*[digit(i) for i in range(n)]).alias("string"))


#: Codon tables by number: amino acids for bases in the order t, c, a, g, first base slowest, '*' for a stop. Fixed values.
CODES: dict[int, str] = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    6: "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    9: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    10: "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    12: "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    13: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG",
    14: "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    15: "FFLLSSSSYY*QCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    16: "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    21: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    22: "FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    23: "FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}
#: Codons that begin a protein by the number of the table; where none is given, atg only. Fixed values.
STARTS: dict[int, tuple[str, ...]] = {
    1: ("ttg", "ctg", "atg"),
    2: ("att", "atc", "ata", "atg", "gtg"),
    4: ("tta", "ttg", "ctg", "att", "atc", "ata", "atg", "gtg"),
    5: ("ttg", "att", "atc", "ata", "atg", "gtg"),
    11: ("ttg", "ctg", "att", "atc", "ata", "atg", "gtg"),
    12: ("ctg", "atg"),
    23: ("att", "atg", "gtg"),
}


def codon_table(number: int = 1) -> dict[str, str]:
    """Amino acid of each codon, '*' for a stop."""
    if number not in CODES:
        raise ValueError(f"no codon table {number}")
    codons = [a + b + c for a in "tcag" for b in "tcag" for c in "tcag"]
    return dict(zip(codons, CODES[number], strict=True))


def start_codons(number: int = 1) -> tuple[str, ...]:
    if number not in CODES:
        raise ValueError(f"no codon table {number}")
    return STARTS.get(number, ("atg",))


def start_places(seqs: DataFrame, table: int = 1) -> DataFrame:
    """Rows (seqnum, pos, codon): every place at which a start codon stands, on the forward strand in all frames."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.length("seq").cast("long") - 3))
    rows = seqs.where(F.length("seq") >= 3).select("seqnum", "seq", at.alias("pos"))
    return rows.select("seqnum", "pos", F.substr(F.col("seq"), (F.col("pos") + 1).cast("int"), F.lit(3)).alias("codon")).where(F.col("codon").isin(*start_codons(table)))


def translate_frame(seq: Column, frame: int, table: int = 1) -> Column:
    """The protein of a lower-case DNA sequence read from `frame` (0 to 2); a codon with a wildcard gives X."""
    code = codon_table(table)
    lookup = F.create_map(*[x for pair in code.items() for x in (F.lit(pair[0]), F.lit(pair[1]))])
    codons = F.regexp_extract_all(F.substring(seq, frame + 1, 2**31 - 1), F.lit("(?s).{3}"), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.element_at(lookup, c), F.lit("X"))), "")


def six_frames(sequences: DataFrame, table: int = 1) -> DataFrame:
    """Six proteins (seqnum, frame, dna_len, seq) of each DNA sequence: frames 0, 1, 2 forward, then 3, 4, 5 on the other strand."""
    forward = [F.struct(F.lit(f).alias("frame"), translate_frame(F.col("seq"), f, table).alias("seq")) for f in range(3)]
    backward = [F.struct(F.lit(f + 3).alias("frame"), translate_frame(reverse_complement(F.col("seq")), f, table).alias("seq")) for f in range(3)]
    return sequences.select("seqnum", F.length("seq").cast("long").alias("dna_len"), F.explode(F.array(*forward, *backward)).alias("f")).select("seqnum", "f.frame", "dna_len", "f.seq")


def frame_to_dna(frame: Column, pos: Column, length: Column, dna_len: Column) -> Column:
    """Where a run of `length` amino acids at `pos` of a frame starts on the forward strand; it spans 3 * length bases."""
    return F.when(frame < 3, pos * 3 + frame).otherwise(dna_len - (pos + length) * 3 - (frame - 3)).cast("long")
