"""Which files belong together: names, pairs, interleaved files, and the working folder's reads."""

from __future__ import annotations

import os
import re
import shutil
import sys
import tempfile

from readloom.functions.adapters import unique
from readloom.sources.fastq import head

EXTENSION = re.compile(r"\.(fastq|fq)(\.(gz|gzip))?$", re.IGNORECASE)


def base_name(path: str) -> str:
    """A file's name without its read-file extension."""
    return EXTENSION.sub("", os.path.basename(path))


def common_name(one: str, two: str) -> str:
    """What two names share from the start, in parts between underscores, whatever their case; else the first name."""
    a, b = base_name(one).split("_"), base_name(two).split("_")
    shared = []
    for x, y in zip(a, b, strict=False):
        if x.lower() != y.lower():
            break
        shared.append(x)
    return "_".join(shared) or base_name(one) or "unknown"


def header_parts(header: str) -> tuple[str, int | None]:
    """The part that mates share, and the read number if the header tells it."""
    if " " in header:
        base, field = header.split(" ", 1)
        found = re.match(r"([12]):.:", field)
        return base, int(found[1]) if found else None
    if header.endswith(("/1", "/2")):
        return header[:-2], int(header[-1])
    return header, None


def in_folder(folder: str = ".") -> list[str]:
    return sorted(os.path.join(folder, n) for n in os.listdir(folder) if EXTENSION.search(n) and os.path.isfile(os.path.join(folder, n)))


def explicit_pairs(paths: list[str]) -> list[tuple[str, str]]:
    if len(paths) % 2:
        raise ValueError("paired input needs an even number of files")
    return list(zip(paths[::2], paths[1::2], strict=True))


def detect(paths: list[str]) -> tuple[list[tuple[str, str]], list[str], list[str], list[str]]:
    """Pairs, interleaved files, unpaired files, and warnings, from the headers of each file's first two records.

    Two files with the same base and read numbers 1 and 2 are a pair. Other groups are not; a file whose own first two
    records share their base is interleaved.
    """
    groups: dict[str, list[tuple[str, int | None]]] = {}
    mixed: set[str] = set()
    for path in unique(paths):
        first = [header_parts(r[0]) for r in head(path, 2)]
        if len(first) == 2 and first[0][0] == first[1][0]:
            mixed.add(path)
        base, number = first[0] if first else (path, None)
        groups.setdefault(base, []).append((path, number))
    pairs, interleaved, unpaired, warnings = [], [], [], []
    for base, members in groups.items():
        if len(members) == 2 and {n for _, n in members} == {1, 2}:
            pairs.append(tuple(p for p, _ in sorted(members, key=lambda m: m[1])))
            continue
        if len(members) > 1:
            warnings.append(f"{len(members)} files begin with {base} and are no pair")
        for path, _ in members:
            (interleaved if path in mixed else unpaired).append(path)
    return pairs, interleaved, unpaired, warnings


def spooled_stdin() -> str:
    """Standard input as a file. ValueError if there is none."""
    if sys.stdin.isatty():
        raise ValueError("no input: standard input is a terminal")
    with tempfile.NamedTemporaryFile(prefix="stdin-", suffix=".fastq", delete=False) as f:
        shutil.copyfileobj(sys.stdin.buffer, f)
        if not f.tell():
            raise ValueError("standard input is empty")
    return f.name


def unique_prefix(name: str, taken: set[str]) -> str:
    """The name, or with _2, _3, ... if it is taken; takes it."""
    k, out = 1, name
    while out in taken:
        k += 1
        out = f"{name}_{k}"
    taken.add(out)
    return out
