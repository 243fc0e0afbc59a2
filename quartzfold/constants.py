"""Fixed values of protein sequences and structures."""

# Residue classes, token letters, extended alphabet.
HYDROPHOBIC = "AVILMFWY"
POLAR = "RKDENQSTH"
SPECIAL = "PCG"
AA20 = "ACDEFGHIKLMNPQRSTVWY"
EXTENDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKENS = "HPpcg"
TOKEN_OF = {**dict.fromkeys(HYDROPHOBIC, "H"), **dict.fromkeys(POLAR, "P"), "P": "p", "C": "c", "G": "g"}

# Hydropathy after Kyte and Doolittle (1982).
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}

# Largest accessible surface of a residue in square angstrom, after Sander and Rost (1994).
MAX_SURFACE = {
    "A": 106, "R": 248, "N": 157, "D": 163, "C": 135, "Q": 198, "E": 194, "G": 84, "H": 184, "I": 169,
    "L": 164, "K": 205, "M": 188, "F": 197, "P": 136, "S": 130, "T": 142, "W": 227, "Y": 222, "V": 142,
}

# Heptad positions and their roles, secondary-structure letters.
HEPTAD = "abcdefg"
HEPTAD_ROLE = {"a": "core", "d": "core", "e": "electrostatic", "g": "electrostatic", "b": "solvent", "c": "solvent", "f": "solvent"}
HELIX, BETA, COIL = "HGI", "EB", "TS "

if set(HYDROPHOBIC) | set(POLAR) | set(SPECIAL) != set(AA20) or len(HYDROPHOBIC + POLAR + SPECIAL) != 20:
    raise ValueError("residue classes must be disjoint and cover the 20 amino acids")
