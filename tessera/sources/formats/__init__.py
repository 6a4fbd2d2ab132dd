"""Structure formats: mmCIF, PDB and BinaryCIF, over one table of atoms.

An atom table is a dict of equally long lists or arrays with the keys of ``ATOM_COLUMNS``. Of several
models only the first is read.
"""

ATOM_COLUMNS = ["chain_id", "res_id", "ins_code", "res_name", "hetero", "atom_name", "element", "x", "y", "z", "b_factor"]
#: Spark type of a structure's atoms.
ATOMS_TYPE = (
    "array<struct<atom_idx:int,chain_id:string,res_id:int,ins_code:string,res_name:string,hetero:boolean,"
    "atom_name:string,element:string,x:double,y:double,z:double,b_factor:double>>"
)
