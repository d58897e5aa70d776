"""Options of a run. A frozen value; ``validate`` rejects settings that no operator accepts."""

from __future__ import annotations

import dataclasses


@dataclasses.dataclass(frozen=True)
class TrimConfig:
    """Defaults leave every module off. An option for one end or mate wins over the one for both."""

    # Whole reads
    min_length_input: int | None = None
    max_length_input: int | None = None
    min_length_output: int | None = None
    max_length_output: int | None = None
    min_length_output_perc: int | None = None
    max_length_output_perc: int | None = None
    min_average_qual_pre: int = 0
    min_average_qual_post: int = 0
    n_filter: bool = False
    # Fixed cuts
    cut: bool = False
    cut_start: int | None = None
    cut_end: int | None = None
    cut_both: int = 0
    # Quality at the ends
    endqual: bool = False
    endqual_min_start: int | None = None
    endqual_min_end: int | None = None
    endqual_min_both: int = 20
    # Sliding window
    slider: bool = False
    slider_window: int = 5
    slider_quality: int = 20
    slider_step: int = 1
    # Homopolymers: the end's defaults are set, so the options for both never reach the 3' end
    poly: bool = False
    poly_bases_start: str | None = None
    poly_bases_end: str | None = "G"
    poly_bases_both: str | None = None
    poly_length_start: int | None = None
    poly_length_end: int | None = 10
    poly_length_both: int | None = None
    # Adapters
    adapter: bool = False
    adapter_seed: int = 6
    adapter_group: tuple[str, ...] = ("TruSeq",)
    adapter_mismatch: int = 2
    adapter_add: str | None = None
    adapter_excl: str | None = None
    adapter_read_1: str | None = None
    adapter_read_2: str | None = None
    # Overlap of mates
    overlap: bool = False
    overlap_mismatches: int = 5
    overlap_min_length: int = 50
    overlap_portion_mismatch: int = 4
    # Low complexity
    kmer: bool = False
    kmer_size: int | str = 4
    kmer_cutoff: int = 50
    # Headers
    mgi_convert: bool = False
    mgi_bc5: str = "PLACEHOLDERi5"
    mgi_bc7: str = "PLACEHOLDERi7"
    mgi_instrument: str = "PLACEHOLDERinstrument"
    mgi_run: str = "PLACEHOLDERrun"
    # Qualities
    reads_for_phred_offset: int = 500
    phred_offset: int | None = None
    phred_out: int | None = None
    # Output
    gzip: bool = False
    gzip_level: int = 1
    stdout: bool = False
    interleaved_out: bool = False
    write_rejected: bool = False
    discard_singles: bool = False
    stats: bool = False
    ordered_output: bool = False
    testrun: bool = False
    chunk_size: int = 1500
    threads: int | None = None

    @classmethod
    def full_auto(cls, **more) -> TrimConfig:
        """The preset: end quality 20, TruSeq adapters with two mismatches, no N, a third of the length, gzip."""
        return cls(**{"endqual": True, "endqual_min_both": 20, "adapter": True, "adapter_group": ("TruSeq",), "adapter_seed": 6, "adapter_mismatch": 2, "n_filter": True, "min_length_output_perc": 33, "gzip": True} | more)

    def of_end(self, name: str, end: str):
        """The option for an end (start, end), or else for both."""
        own = getattr(self, f"{name}_{end}")
        return getattr(self, f"{name}_both") if own is None else own

    @property
    def kmer_sizes(self) -> list[int]:
        return [int(k) for k in str(self.kmer_size).split(",")]

    def modules(self, mate: int = 0) -> list[str]:
        """Modules that are on, in the order of the statistics."""
        on = {
            "kmer": self.kmer, "poly": self.poly, "adapter": self.adapter, "endqual": self.endqual,
            "avgqual_pre": self.min_average_qual_pre > 0, "slider": self.slider, "cut": self.cut, "overlap": self.overlap and mate > 0,
        }
        return [name for name, used in on.items() if used]

    def validate(self) -> TrimConfig:
        def need(ok: bool, text: str) -> None:
            if not ok:
                raise ValueError(text)

        for name in ("min_average_qual_pre", "min_average_qual_post"):
            need(0 <= getattr(self, name) <= 127, f"{name}: 0 to 127")
        for name in ("endqual_min_start", "endqual_min_end", "endqual_min_both"):
            need(getattr(self, name) is None or 0 <= getattr(self, name) <= 93, f"{name}: 0 to 93")
        need(1 <= self.adapter_seed <= 99, "adapter_seed: 1 to 99")
        need(self.adapter_mismatch >= 0, "adapter_mismatch: 0 or more")
        need(0 <= self.gzip_level <= 3, "gzip_level: 0 to 3")
        need(self.phred_offset in (None, 33, 64) and self.phred_out in (None, 33, 64), "Phred offsets: 33 or 64")
        if self.slider:
            need(self.slider_window >= 1 and self.slider_step >= 1, "slider_window, slider_step: 1 or more")
        if self.kmer:
            need(all(1 <= k <= 21 for k in self.kmer_sizes), "kmer_size: 1 to 21")
        if self.poly:
            for end in ("start", "end"):
                need(all(len(b.strip()) == 1 for b in (self.of_end("poly_bases", end) or "").split(",") if b.strip()), "poly_bases: single letters between commas")
        return self
