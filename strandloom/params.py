"""Run parameters: one option table for the command line, TOML files and validation."""

from __future__ import annotations

import argparse
import math
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any, NoReturn


class ParameterError(ValueError):
    """A parameter or an input that cannot be used."""


@dataclass(frozen=True)
class Option:
    name: str
    flags: tuple[str, ...]
    kind: type
    help: str
    toml: str | None = ""  # key in a params file if it differs; None: command line only


# The flags and TOML keys users know.
OPTIONS = (
    Option("kmer_size", ("--kmer-size",), int, "k-mer size of minimizers, 1 to 16"),
    Option("window_size", ("--window-size",), int, "k-mers in a minimizer window"),
    Option("hash_seed", ("--minimizer-hash-seed",), int, "seed of the k-mer order", None),
    Option("fragment_length", ("--fragment-length",), int, "length of query fragments"),
    Option("fragment_stride", ("--fragment-stride",), int, "step between fragments; the length by default"),
    Option("min_fragment_length", ("--min-fragment-length", "--min-fraglen"), int, "shortest fragment; the length by default"),
    Option("split_n_run", ("--split-N", "--split-n"), int, "split contigs at so many N; 0 never"),
    Option("mash_threshold", ("--mash-threshold",), float, "least identity of a fragment in percent; 0 for none"),
    Option("mash_confidence", ("--mash-confidence",), float, "confidence of the identity's upper bound"),
    Option("mphf_gamma", ("--mphf-gamma",), float, "accepted for compatibility; the index is a table"),
    Option("max_shard_minimizers", ("--max-shard-minimizers",), int, "estimated minimizers in a shard"),
    Option("index_build_mode", ("--index-build-mode",), str, "auto, hash or partitioned; accepted for compatibility"),
    Option("max_reference_frequency", ("--max-reference-frequency",), float, "percent of keys to ignore, most frequent first", "freq_threshold_percent"),
    Option("minmer_count", ("--minmer-count",), int, "seed with so many keys of a fragment"),
    Option("shards", ("--shards",), str, "shards to query, such as 1,3,5-8"),
    Option("threads", ("--threads",), int, "local threads if no session is given"),
    Option("tmp", ("--tmp",), str, "folder for temporary files"),
    Option("out", ("--out",), str, "results file; standard output by default"),
    Option("mapping_stats", ("--mapping-stats",), str, "also write a row for every mapping here"),
    Option("reference_sketch", ("--reference-sketch",), str, "build or reuse an index in this folder"),
    Option("query_name", ("--query-name",), str, "label of the query from standard input"),
    Option("header", ("--header",), bool, "begin with a header row"),
    Option("bgzip", ("--bgzip",), bool, "compress the index more"),
    Option("force", ("--force",), bool, "overwrite an index when only building"),
    Option("verbose", ("--verbose",), bool, "report progress"),
    Option("quiet", ("--quiet", "--silent"), bool, "no parameter echo and no summary"),
    Option("skip_validation", ("--skip-validation",), bool, "do not check input files", None),
    Option("per_contig", ("--per-contig",), bool, "a row for every query contig", None),
)
INPUTS = (("reference", "file"), ("reference", "list"), ("query", "file"), ("query", "list"))


@dataclass(frozen=True)
class Genome:
    """A FASTA input: where to read it, and what to call it."""

    path: str
    label: str


@dataclass(frozen=True)
class Parameters:
    kmer_size: int = 16
    window_size: int = 24
    hash_seed: int = 42
    fragment_length: int = 3000
    fragment_stride: int | None = None
    min_fragment_length: int | None = None
    split_n_run: int = 0
    mash_threshold: float = 80.0
    mash_confidence: float = 0.9
    mphf_gamma: float = 10.0
    max_shard_minimizers: int = 500_000_000
    index_build_mode: str = "auto"
    max_reference_frequency: float = 0.0
    minmer_count: int | None = None
    shards: str | None = None
    threads: int = 1
    tmp: str | None = None
    out: str | None = None
    mapping_stats: str | None = None
    reference_sketch: str | None = None
    query_name: str | None = None
    header: bool = False
    bgzip: bool = False
    force: bool = False
    verbose: bool = False
    quiet: bool = False
    skip_validation: bool = False
    per_contig: bool = False
    references: tuple[Genome, ...] = ()
    queries: tuple[Genome, ...] = ()
    sources: dict[str, str] = field(default_factory=dict, compare=False)

    @property
    def stride(self) -> int:
        return self.fragment_stride if self.fragment_stride is not None else self.fragment_length

    @property
    def least(self) -> int:
        return self.min_fragment_length if self.min_fragment_length is not None else self.fragment_length

    @property
    def is_standard(self) -> bool:
        """Whole, adjacent fragments only."""
        return self.stride == self.fragment_length == self.least

    def shard_numbers(self) -> list[int] | None:
        return None if self.shards is None else parse_shards(self.shards)


def parse_shards(text: str) -> list[int]:
    """The numbers of a list such as 1,3,5-8, ascending."""
    found: set[int] = set()
    for part in text.split(","):
        low, dash, high = part.strip().partition("-")
        if not low.isdigit() or (dash and not high.isdigit()):
            raise ParameterError(f"--shards: '{part}' is no shard number or range")
        first, last = int(low), int(high) if dash else int(low)
        if last < first:
            raise ParameterError(f"--shards: the range '{part}' is inverted")
        found.update(range(first, last + 1))
    return sorted(found)


def validate(p: Parameters) -> Parameters:
    def need(ok: bool, message: str) -> None:
        if not ok:
            raise ParameterError(message)

    def inside(x: float, low: float, high: float) -> bool:
        return math.isfinite(x) and low <= x <= high

    need(p.threads >= 1, "--threads must be at least 1")
    need(inside(p.max_reference_frequency, 0, 100), "--max-reference-frequency must be between 0 and 100")
    need(p.minmer_count is None or p.minmer_count >= 1, "--minmer-count must be at least 1")
    need(1 <= p.kmer_size <= 16, "--kmer-size must be between 1 and 16")
    need(p.window_size >= 1, "--window-size must be at least 1")
    need(0 <= p.hash_seed < 2**32, "--minimizer-hash-seed must fit 32 bits")
    need(p.fragment_length >= 1, "--fragment-length must be at least 1")
    need(1 <= p.stride <= p.fragment_length, f"--fragment-stride must be between 1 and --fragment-length ({p.fragment_length})")
    need(1 <= p.least <= p.fragment_length, f"--min-fragment-length must be between 1 and --fragment-length ({p.fragment_length})")
    need(p.split_n_run >= 0, "--split-N must not be negative")
    need(inside(p.mash_threshold, 0, 100), "--mash-threshold must be a finite value between 0 and 100")
    need(inside(p.mash_confidence, 0, 1), "--mash-confidence must be a finite value between 0 and 1")
    need(math.isfinite(p.mphf_gamma) and p.mphf_gamma > 1.01, "--mphf-gamma must be a finite value greater than 1.01")
    need(p.max_shard_minimizers >= 1, "--max-shard-minimizers must be at least 1")
    need(p.index_build_mode in ("auto", "hash", "partitioned"), "--index-build-mode must be auto, hash or partitioned")
    p.shard_numbers()
    need(p.shards is None or p.reference_sketch is not None, "--shards requires --reference-sketch")
    need(bool(p.references) or p.reference_sketch is not None, "a reference or --reference-sketch is required")
    need(bool(p.queries) or p.reference_sketch is not None, "a query is required unless only a sketch is built")
    need(not any(is_stdin(g.path) for g in p.references), "references cannot be read from standard input")
    piped = sum(is_stdin(g.path) for g in p.queries)
    need(piped <= 1, "only one query can come from standard input")
    need(p.query_name is None or piped == 1, "--query-name needs a query from standard input")
    return p


def is_stdin(path: str) -> bool:
    return path in ("-", "/dev/stdin")


SMALLEST_FASTA = 100


def check_fasta(path: Path, kind: str, listed_in: str | None = None, as_written: str | None = None) -> None:
    """A FASTA input must be a regular file of more than SMALLEST_FASTA bytes."""
    if listed_in is None:
        reach = f"Cannot access {kind.lower()} file {path}"
        small, other = f"{kind} file is too small: {path}", f"{kind} path is not a file: {path}"
    else:
        reach = f"Cannot access path '{as_written}' from list: {listed_in}"
        small, other = f"Path in list is too small: {as_written}", f"Path in list is not a file: {as_written}"
    try:
        size, regular = path.stat().st_size, path.is_file()
    except OSError as error:
        raise ParameterError(f"{reach}: {error.strerror}") from error
    if not regular:
        raise ParameterError(other)
    if size <= SMALLEST_FASTA:
        raise ParameterError(f"{small} ({size} bytes, must be > {SMALLEST_FASTA})")


def genomes_of_list(path: Path, base: Path, kind: str, validated: bool) -> list[Genome]:
    """The FASTA files that a list names, one a line; blank lines and those that begin with # are skipped. They are
    labelled by their absolute paths."""
    try:
        lines = path.read_text().splitlines()
    except OSError as error:
        raise ParameterError(f"Cannot read {kind.lower()} list {path}: {error.strerror}") from error
    found = []
    for entry in (line.strip() for line in lines):
        if entry and not entry.startswith("#"):
            at = base / entry
            if validated:
                check_fasta(at, kind, str(path), entry)
            found.append(Genome(str(at), str(at.absolute())))
    return found


def read_params_file(path: str) -> dict[str, Any]:
    """The settings of a TOML file by parameter name; unknown keys and wrong types are refused."""
    at = Path(path)
    if not at.exists():
        raise ParameterError(f"Cannot access params file {path}")
    if not at.is_file():
        raise ParameterError(f"Params path is not a file: {path}")
    try:
        raw = tomllib.loads(at.read_text())
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as error:
        raise ParameterError(f"Failed to parse params file at {path}: {error}") from error
    kinds = {o.toml or o.name: o for o in OPTIONS if o.toml is not None}
    lists = {f"{side}_{kind}s": (side, kind) for side, kind in INPUTS}
    found: dict[str, Any] = {}
    for key, value in raw.items():
        if key in lists:
            if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
                raise ParameterError(f"{path}: {key} must be a list of strings")
            found[key] = value
        elif key in kinds:
            kind = kinds[key].kind
            number = kind is float and isinstance(value, int) and not isinstance(value, bool)
            if not number and type(value) is not kind:
                raise ParameterError(f"{path}: {key} must be of type {kind.__name__}")
            found[kinds[key].name] = kind(value)
        else:
            raise ParameterError(f"{path}: unknown key '{key}'")
    return found


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> NoReturn:
        raise ParameterError(message)


def _parser() -> argparse.ArgumentParser:
    from strandloom import __version__

    parser = _Parser(prog="strandloom", allow_abbrev=False, description="Average nucleotide identity of genomes on Spark.")
    parser.add_argument("-v", "--version", action="version", version=__version__)
    parser.add_argument("--params-file", action="append", default=[], help="TOML file with parameters; the command line overrides its values")
    for side, kind in INPUTS:
        flag = f"--{side}" + ("-list" if kind == "list" else "")
        parser.add_argument(flag, action="append", default=[], dest=f"{side}_{kind}s", help=f"{side} FASTA {kind}, repeatable")
    for o in OPTIONS:
        kind = {"action": "store_const", "const": True} if o.kind is bool else {"type": o.kind}
        parser.add_argument(*o.flags, dest=o.name, default=None, help=o.help, **kind)
    return parser


def parse(argv: list[str]) -> Parameters:
    """Parameters of a command line and its params file, validated. Single values of the command line win; inputs
    of both are combined, the file's first, files before lists."""
    arguments = vars(_parser().parse_args(argv))
    if len(arguments["params_file"]) > 1:
        raise ParameterError("--params-file can be given once")
    from_file: dict[str, Any] = {}
    base = Path()
    if arguments["params_file"]:
        from_file = read_params_file(arguments["params_file"][0])
        base = Path(arguments["params_file"][0]).parent
    names = [o.name for o in OPTIONS]
    given = {n: from_file[n] for n in names if n in from_file}
    for name in ("tmp", "out", "mapping_stats", "reference_sketch"):
        if name in given:
            given[name] = str(base / given[name])
    sources = dict.fromkeys(given, "params file")
    own = {n: arguments[n] for n in names if arguments[n] is not None}
    sources |= dict.fromkeys(own, "CLI")
    p = replace(Parameters(), **(given | own), sources=sources)
    checked = not p.skip_validation
    sides: dict[str, list[Genome]] = {"reference": [], "query": []}
    for settings, root, absolute in ((from_file, base, True), (arguments, Path(), False)):
        for side, kind in INPUTS:
            for entry in settings.get(f"{side}_{kind}s", []):
                if kind == "list":
                    at = root / entry
                    sides[side] += genomes_of_list(at, at.parent if absolute else Path(), side.capitalize(), checked)
                elif is_stdin(entry):
                    sides[side].append(Genome(entry, p.query_name or "-"))
                else:
                    at = root / entry
                    if checked:
                        check_fasta(at, side.capitalize())
                    sides[side].append(Genome(str(at), str(at.absolute()) if absolute else entry))
    return validate(replace(p, references=tuple(sides["reference"]), queries=tuple(sides["query"])))


def echo(p: Parameters) -> str:
    """The values that are not default, as TOML with where they come from."""
    keys = {o.name: o.toml or o.name for o in OPTIONS}
    shown = []
    for name, source in sorted(p.sources.items()):
        value = getattr(p, name)
        text = str(value).lower() if isinstance(value, bool) else f'"{value}"' if isinstance(value, str) else str(value)
        shown.append(f"{keys[name]} = {text}  # from {source}")
    return "\n".join(shown)
