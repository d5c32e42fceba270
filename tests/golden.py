"""Golden values recorded from the reference's saved model runs.

Fixed values: the 8-occasion, two-group "all detections" frequency table
(history, count in group ham.ds, count in group ham.us) and the listing's
estimates for it. Kept as literals; nothing is read from the reference.
"""

M018_FREQ = [
    ("10000000", 0, 4), ("10000000", 3, 0), ("11000000", 0, 65), ("11000000", 63, 0),
    ("11000010", 0, 1), ("11000100", 0, 1), ("11000100", 6, 0), ("11000101", 0, 1),
    ("11001000", 1, 0), ("11001100", 0, 1), ("11001100", 1, 0), ("11001101", 0, 1),
    ("11010000", 1, 0), ("11010100", 0, 1), ("11010100", 1, 0), ("11011100", 0, 1),
    ("11011100", 1, 0), ("11011101", 1, 0), ("11100000", 0, 5), ("11100000", 7, 0),
    ("11100001", 0, 2), ("11100100", 0, 2), ("11100100", 5, 0), ("11100101", 0, 1),
    ("11100110", 1, 0), ("11101000", 0, 3), ("11101000", 1, 0), ("11101100", 0, 4),
    ("11101100", 1, 0), ("11101101", 0, 2), ("11101101", 2, 0), ("11110000", 0, 2),
    ("11110000", 2, 0), ("11110100", 0, 2), ("11110100", 4, 0), ("11110111", 1, 0),
    ("11111000", 0, 3), ("11111001", 0, 1), ("11111100", 2, 0), ("11111101", 1, 0),
]
M018_GROUPS = ("ham.ds", "ham.us")

# Phi(~1)p(~1) on M018_FREQ
M018_DOT = {
    "beta": (1.0321724, 0.7982254), "se": (0.0903310, 0.1182000),
    "neg2lnl": 1204.6226, "neg2lnl_sat": 711.22111, "ess": 561,
    "deviance": 493.40152, "deviance_df": 36, "pearson_chisq": 1017.5829,
    "possible": 256, "pearson_df": 252, "s_bar": 0.2286918, "fletcher_chat": 3.2864447,
    "aicc": 1208.6441,
}
# Phi(~release)p(~1) on M018_FREQ (release ham.us vs reference ham.ds)
M018_GROUP = {"beta": (1.0417078, -0.0193501, 0.7980874), "neg2lnl": 1204.6107}


def m018_long():
    """(ch, grp, n) rows with zero cells dropped."""
    out = []
    for ch, a, b in M018_FREQ:
        if a:
            out.append((ch, M018_GROUPS[0], a))
        if b:
            out.append((ch, M018_GROUPS[1], b))
    return out

# 7-occasion, two-group table (history, count group 1, count group 2)
M001_FREQ = [
    ("0011010", 1, 0), ("0100000", 0, 1), ("1000000", 0, 1), ("1000000", 6, 0),
    ("1100000", 0, 69), ("1100000", 59, 0), ("1100010", 1, 0), ("1100100", 1, 0),
    ("1101000", 0, 1), ("1101000", 6, 0), ("1101001", 0, 1), ("1101010", 0, 1),
    ("1101010", 1, 0), ("1101011", 0, 1), ("1101100", 0, 1), ("1101100", 1, 0),
    ("1101110", 0, 1), ("1101110", 1, 0), ("1101111", 1, 0), ("1110000", 0, 5),
    ("1110000", 7, 0), ("1110001", 0, 2), ("1110010", 0, 3), ("1110010", 1, 0),
    ("1110100", 0, 2), ("1110100", 2, 0), ("1110110", 0, 3), ("1110111", 0, 1),
    ("1111000", 0, 2), ("1111000", 6, 0), ("1111001", 0, 1), ("1111010", 0, 3),
    ("1111010", 1, 0), ("1111011", 0, 2), ("1111011", 2, 0), ("1111100", 0, 2),
    ("1111100", 4, 0), ("1111101", 1, 0), ("1111110", 2, 0), ("1111111", 1, 0),
]
# Phi(t)p(t) moment estimates where no boundary binds (occasion: value)
M003_PHI = {1: 0.96602, 2: 0.38071}
M003_P = {3: 0.69606, 6: 0.61538}
M003_LAST_PRODUCT = 0.29630
M001_DOT = {"neg2lnl": 1053.4074, "neg2lnl_sat": 683.18510, "ess": 555, "deviance": 370.22233,
            "deviance_df": 34, "possible": 176, "s_bar": 0.1557196}
M003_NEG2LNL = 740.81432


def m001_long():
    out = []
    for ch, a, b in M001_FREQ:
        if a:
            out.append((ch, "g1", a))
        if b:
            out.append((ch, "g2", b))
    return out
