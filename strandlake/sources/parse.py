"""Parsers of structure files: bytes in, structures out; no Spark in here."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
from dataclasses import dataclass, field

from ..functions.residues import letter_of
from ..options import ReadOptions

LARGEST_MEMBER, SMALLEST_MEMBER = 128 << 20, 10


@dataclass
class Atom:
    """A representative atom."""

    model: str
    chain: str
    name: str
    number: int
    ins: str
    xyz: tuple[float, float, float]
    nucleic: bool


@dataclass
class Structure:
    member: str
    model: str
    chain: str
    atoms: list[Atom] = field(default_factory=list)

    def row(self, options: ReadOptions) -> dict:
        vote = sum(1 if a.nucleic else -1 for a in self.atoms)
        chains = list(dict.fromkeys(a.chain for a in self.atoms))
        return {
            "member": self.member, "model": self.model, "chain": self.chain,
            "mol_type": options.mol or ("NA" if vote > 0 else "Protein"), "length": len(self.atoms),
            "seq": "".join(letter_of(a.name) for a in self.atoms), "x": [a.xyz[0] for a in self.atoms], "y": [a.xyz[1] for a in self.atoms],
            "z": [a.xyz[2] for a in self.atoms], "res_num": [a.number for a in self.atoms], "ins_code": "".join(a.ins or " " for a in self.atoms),
            "chain_ord": [chains.index(a.chain) for a in self.atoms],
        }


def is_tar(path: str) -> bool:
    return re.search(r"\.tar(\.gz)?$|\.tgz$", path, re.I) is not None


def tar_members(file) -> list[tuple[str, int, int]]:
    """(name, offset, size) of the regular files of an uncompressed tar, by its headers alone."""
    with tarfile.open(fileobj=file, mode="r:") as tar:
        return [(m.name, m.offset_data, m.size) for m in tar if m.isreg() and SMALLEST_MEMBER <= m.size <= LARGEST_MEMBER]


def members(path: str, content: bytes):
    """(member, bytes) of a file: the regular files of a tar, and gzip undone at either level."""
    if is_tar(path):
        with tarfile.open(fileobj=io.BytesIO(inflate(content))) as tar:
            for m in tar:
                if m.isreg() and SMALLEST_MEMBER <= m.size <= LARGEST_MEMBER:
                    yield m.name, inflate(tar.extractfile(m).read())
    else:
        yield "", inflate(content)


def inflate(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def file_format(name: str, options: ReadOptions) -> str:
    """By extension, below any .gz; what is unknown is read as PDB."""
    if options.infmt:
        return options.infmt
    return "cif" if re.search(r"\.(cif|mmcif)(\.gz)?$", name, re.I) else "pdb"


def pdb_events(text: str, options: ReadOptions):
    """("atom", Atom), ("ter", None) and ("end", None) in file order."""
    model = ""
    wanted = ("ATOM  ", "HETATM") if options.hetatm else ("ATOM  ",)
    for line in text.splitlines():
        kind = line[:6].ljust(6)
        if kind == "MODEL ":
            model = line[6:].strip()
        elif kind.startswith("TER"):
            yield "ter", None
        elif kind.startswith("END"):
            yield "end", None
        elif kind in wanted and line[16:17] in (" ", "A", "") and line[12:16] in (options.aatom, options.natom):
            nucleic = line[17:18] == " " and line[18:19] in (" ", "D")
            yield "atom", Atom(model, line[21:22], line[17:20], int(line[22:26]), line[26:27].strip(), (float(line[30:38]), float(line[38:46]), float(line[46:54])), nucleic)


#: A value of an mmCIF loop: quoted up to a quote before white space, or bare.
_VALUE = re.compile(r"""'((?:[^'\n]|'(?=\S))*)'(?=\s|$)|"((?:[^"\n]|"(?=\S))*)"(?=\s|$)|(\S+)""")
_NEEDED = (("group_PDB",), ("label_atom_id",), ("label_comp_id",), ("auth_asym_id", "label_asym_id"), ("auth_seq_id", "label_seq_id"), ("Cartn_x",), ("Cartn_y",), ("Cartn_z",))


def cif_events(text: str, options: ReadOptions):
    """As ``pdb_events`` for the _atom_site loop, whose rows may be broken over lines.

    Author's chains and residue numbers come first, residue names are those of the label; an alternative
    location must be ``.`` or begin with A.
    """
    columns: dict[str, int] = {}
    inside, model, held = False, None, []
    wanted = ("ATOM", "HETATM") if options.hetatm else ("ATOM",)
    names = (options.aatom.strip(), options.natom.strip())
    for line in text.splitlines():
        s = line.strip()
        if s == "loop_":
            inside, columns, held = False, {}, []
        elif s.startswith("_atom_site."):
            columns[s.split(".", 1)[1].split()[0]] = len(columns)
            inside = True
        elif inside and s and not s.startswith(("#", "_", "data_")):
            if not held and len(columns) and (missing := [k for k in _NEEDED if not any(c in columns for c in k)]):
                raise ValueError(f"_atom_site has no {missing[0][0]}")
            held += [a or b or c for a, b, c in _VALUE.findall(s)]
            while len(held) >= len(columns):
                v, held = held[: len(columns)], held[len(columns) :]
                pick = lambda *keys: next((v[columns[k]] for k in keys if k in columns), "")  # noqa: E731, B023
                if pick("group_PDB") not in wanted or pick("label_atom_id") not in names or "label_alt_id" in columns and pick("label_alt_id")[:1] not in (".", "A"):
                    continue
                own = pick("pdbx_PDB_model_num")
                if model not in (None, own):
                    yield "end", None
                model = own
                res, ins, name = pick("label_comp_id"), pick("pdbx_PDB_ins_code"), pick("auth_asym_id", "label_asym_id")
                xyz = tuple(float(pick(f"Cartn_{a}")) for a in "xyz")
                nucleic = len(res) == 1 or len(res) == 2 and res[0] == "D"
                yield "atom", Atom(own, " " if name == "." else name, res.rjust(3), int(pick("auth_seq_id", "label_seq_id")), "" if ins in (".", "?") else ins, xyz, nucleic)
        elif inside and s.startswith(("#", "_", "data_")):
            inside, held = False, []


def structures(name: str, content: bytes, options: ReadOptions) -> list[Structure]:
    """The structures of one file.

    ter 0 reads on to the end of the file, 1 stops at the end of a model, 2 also at a change of
    chain, 3 also at a TER.  split 1 starts a structure at each model, 2 at each
    chain.
    """
    text = content.decode("latin-1")
    events = (cif_events if file_format(name, options) == "cif" else pdb_events)(text, options)
    out: list[Structure] = []
    ended = False
    for kind, atom in events:
        if kind != "atom":
            if out and (kind == "end" and options.ter >= 1 or kind == "ter" and options.ter == 3):
                break
            ended = ended or kind == "end"
            continue
        last = out[-1].atoms[-1] if out else None
        if last:
            if options.ter >= 2 and atom.chain != last.chain:
                break
            fresh = options.split >= 1 and (atom.model != last.model or ended) or options.split == 2 and atom.chain != last.chain
        if not last or fresh:
            out.append(Structure("", atom.model, atom.chain))
        elif (atom.number, atom.ins, atom.chain, atom.model) == (last.number, last.ins, last.chain, last.model):
            continue  # a residue has one representative
        ended = False
        out[-1].atoms.append(atom)
    return out
