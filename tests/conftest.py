import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from residuum.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


#: Two short chains, one calcium, one ligand, alternate conformers, a water, an additive, hydrogens.
PDB_ROWS = [
    ("ATOM", 1, "N", "", "LYS", "A", 1, 0.0, 0.0, 0.0, 1.0, 10.0, "N"),
    ("ATOM", 2, "CA", "", "LYS", "A", 1, 1.458, 0.0, 0.0, 1.0, 20.0, "C"),
    ("ATOM", 3, "CB", "A", "LYS", "A", 1, 2.0, 1.4, 0.0, 0.4, 30.0, "C"),
    ("ATOM", 4, "CB", "B", "LYS", "A", 1, 2.0, -1.4, 0.0, 0.6, 30.0, "C"),
    ("ATOM", 5, "C", "", "LYS", "A", 1, 2.0, 0.0, 1.4, 1.0, 10.0, "C"),
    ("ATOM", 6, "O", "", "LYS", "A", 1, 3.2, 0.0, 1.5, 0.0, 10.0, "O"),
    ("ATOM", 7, "H", "", "LYS", "A", 1, 0.1, 0.9, 0.0, 1.0, 10.0, "H"),
    ("ATOM", 8, "N", "", "MSE", "A", 2, 1.2, 0.0, 2.4, 1.0, 10.0, "N"),
    ("ATOM", 9, "CA", "", "MSE", "A", 2, 1.6, 0.0, 3.8, 1.0, 10.0, "C"),
    ("ATOM", 10, "N", "", "ASP", "B", 7, 8.0, 8.0, 8.0, 1.0, 90.0, "N"),
    ("ATOM", 11, "CA", "", "ASP", "B", 7, 9.0, 8.0, 8.0, 1.0, 90.0, "C"),
    ("HETATM", 12, "CA", "", "CA", "A", 101, 5.0, 5.0, 5.0, 1.0, 5.0, "CA"),
    ("HETATM", 13, "C1", "", "XYZ", "B", 201, 6.0, 6.0, 6.0, 1.0, 5.0, "C"),
    ("HETATM", 14, "O2", "", "XYZ", "B", 201, 7.0, 6.0, 6.0, 1.0, 5.0, "O"),
    ("HETATM", 15, "O", "", "HOH", "A", 301, 4.0, 4.0, 4.0, 1.0, 5.0, "O"),
    ("HETATM", 16, "S", "", "SO4", "A", 302, 3.0, 4.0, 4.0, 1.0, 5.0, "S"),
]


def pdb_text(rows=PDB_ROWS):
    lines = []
    for rec, serial, atom, alt, res, chain, seq, x, y, z, occ, b, el in rows:
        name = atom if len(atom) >= 4 or len(el) > 1 else f" {atom}"
        lines.append(f"{rec:<6}{serial:>5} {name:<4}{alt or ' ':1}{res:>3} {chain}{seq:>4}    "
                     f"{x:8.3f}{y:8.3f}{z:8.3f}{occ:6.2f}{b:6.2f}          {el:>2}")
    return "\n".join([*lines, "END", ""])


def cif_text(rows=PDB_ROWS):
    head = ("group_PDB id type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z "
            "occupancy B_iso_or_equiv auth_seq_id auth_asym_id pdbx_PDB_model_num").split()
    body = [f"{rec} {serial} {el} {atom} {alt or '.'} {res} {chain} . ? {x} {y} {z} {occ} {b} {seq} {chain} 1"
            for rec, serial, atom, alt, res, chain, seq, x, y, z, occ, b, el in rows]
    gen = ["#", "_pdbx_struct_assembly_gen.assembly_id 1", "_pdbx_struct_assembly_gen.oper_expression 1,2", "_pdbx_struct_assembly_gen.asym_id_list A,B"]
    oper = ["#", "loop_", "_pdbx_struct_oper_list.id", "_pdbx_struct_oper_list.type"]
    oper += [f"_pdbx_struct_oper_list.{n}" for n in [f"matrix[{i}][{j}]" for i in (1, 2, 3) for j in (1, 2, 3)] + [f"vector[{i}]" for i in (1, 2, 3)]]
    oper += ["1 'identity operation' 1 0 0 0 1 0 0 0 1 0 0 0", "2 'crystal symmetry operation' -1 0 0 0 -1 0 0 0 1 50 60 70"]
    return "\n".join(["data_X", *gen, *oper, "#", "loop_", *[f"_atom_site.{h}" for h in head], *body, "#", ""])
