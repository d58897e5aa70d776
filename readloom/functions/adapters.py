"""Adapter sequences: built-in groups, resolution of the options, FASTA and inline lists, selection for a mate.

Oligonucleotide sequences © 2026 Illumina, Inc. All rights reserved.
"""

from __future__ import annotations

import os
import re

#: Published adapter sequences, by kit.
GROUPS: dict[str, list[tuple[str, str]]] = {
    "AmpliSeq": [("AmpliSeq", "CTGTCTCTTATACACATCT")],
    "Illumina_miRNA": [("Illumina_miRNA", "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA")],
    "Illumina_RNA": [("Illumina_RNA", "ACTGTCTCTTATACACATCT")],
    "Nextera": [("Nextera", "CTGTCTCTTATACACATCT")],
    "TruSeq": [("Read 1", "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"), ("Read 2", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT")],
    "TruSeq_DNA_methylation": [("Read 1", "AGATCGGAAGAGCACACGTCTGAAC"), ("Read 2", "AGATCGGAAGAGCGTCGTGTAGGGA")],
    "TruSeq_Ribo_profile": [("TruSeq_Ribo_profile", "AGATCGGAAGAGCACACGTCT")],
    "TruSeq_small_RNA": [("TruSeq_small_RNA", "TGGAATTCTCGGGTGCCAAGG")],
}


def unique(items) -> list:
    return list(dict.fromkeys(items))


def read_fasta(path: str) -> list[tuple[str, str]]:
    """(name, sequence) of each record; ends at the first empty line. ValueError if a record is malformed."""
    found: list[tuple[str, list[str]]] = []
    with open(path, encoding="utf-8") as f:
        for line in f:
            text = line.strip()
            if not text:
                break
            if text.startswith(">"):
                if found and not found[-1][1]:
                    raise ValueError(f"{path}: {found[-1][0]} has no sequence")
                found.append((text[1:].strip(), []))
            elif not found:
                raise ValueError(f"{path}: the first line must begin with >")
            else:
                if not re.fullmatch("[ACGTNacgtn]+", text):
                    raise ValueError(f"{path}: {found[-1][0]} has letters other than A, C, G, T and N")
                found[-1][1].append(text.upper())
    if not found or not found[-1][1]:
        raise ValueError(f"{path}: no adapter, or one without a sequence")
    return [(name, "".join(parts)) for name, parts in found]


def load(argument: str) -> list[tuple[str, str]]:
    """A FASTA file's records, or a list of sequences between commas, named custom_1, custom_2, ...; empty items don't count."""
    if os.path.isfile(argument):
        return read_fasta(argument)
    parts = [p for p in (x.strip().upper() for x in argument.split(",")) if p]
    if not parts or not all(re.fullmatch("[ACGTN]+", p) for p in parts):
        raise ValueError(f"neither a file nor a list of sequences: {argument}")
    return [(f"custom_{i}", p) for i, p in enumerate(parts, 1)]


def resolve(groups: list[str], add: str | None = None, only: str | None = None) -> list[tuple[str, str]]:
    """The entries searched for: ``only`` alone, or the groups (all: every one) and ``add``. Equal entries count once."""
    if only:
        return unique(load(only))
    names = list(GROUPS) if "all" in groups else groups
    unknown = [g for g in names if g not in GROUPS]
    if unknown:
        raise ValueError(f"unknown adapter groups: {', '.join(unknown)}")
    return unique([e for g in names for e in GROUPS[g]] + (load(add) if add else []))


def for_mate(entries: list[tuple[str, str]], mate: int, groups: list[str] | None = None, read_1: str | None = None, read_2: str | None = None) -> list[str]:
    """Sequences searched for in a mate (0: unpaired, 1, 2).

    Lists given for the mates win: a mate without one has nothing to search, an unpaired read all of them. Otherwise a
    sequence goes if the chosen built-in groups have it for the other mate ("Read 1", "Read 2") only. Without groups
    nothing goes.
    """
    if read_1 or read_2:
        own = {0: (read_1, read_2), 1: (read_1,), 2: (read_2,)}[mate]
        return unique(seq for argument in own if argument for _, seq in load(argument))
    sequences = unique(seq for _, seq in entries)
    if mate == 0 or not groups:
        return sequences
    chosen = [e for g in (GROUPS if "all" in groups else groups) for e in GROUPS[g]]
    mine = {seq for name, seq in chosen if name != f"Read {3 - mate}"}
    others = {seq for name, seq in chosen if name == f"Read {3 - mate}"} - mine
    return [seq for seq in sequences if seq not in others]
