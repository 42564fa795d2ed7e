"""Fixed values. They must equal the published ones for results to match."""

from __future__ import annotations

from fieldline.schema import EventSpec

# --- event type, subtype and tag codes --------------------------------------
DUEL, FOUL, FREE_KICK, OFFSIDE, PASS, SHOT = 1, 2, 3, 6, 8, 10
SUB_TACKLE, SUB_FOUL = 12, 20
TAG_GOAL, TAG_ASSIST, TAG_KEY_PASS = 101, 301, 302
TAG_LEFT, TAG_RIGHT = 401, 402
TAG_TACKLE_WON, TAG_INTERCEPTION = 703, 1401
TAG_YELLOW, TAG_ACCURATE = 1702, 1801

# --- event kinds whose share is measured per player and period --------------
# 'foul' is measured once and published under two names, see FOUL_SHARE_NAMES.
SHARE_SPECS = [
    EventSpec("foul", 2, 20),
    EventSpec("accurate_pass", 8, None, 1801, share_of="player"),
    EventSpec("accurate_shot", 10, 100, 1801, share_of="player"),
    EventSpec("duel", 1),
    EventSpec("fk_corner", 3, 30),
    EventSpec("fk_cross", 3, 32),
    EventSpec("fk_shot", 3, 33),
    EventSpec("interception", None, None, 1401),
    EventSpec("key_pass", None, None, 302),
    EventSpec("offside", 6, 60),
    EventSpec("pass_cross", 8, 80),
    EventSpec("pass_high", 8, 83),
    EventSpec("pass_simple", 8, 85),
    EventSpec("pass_smart", 8, 86),
    EventSpec("shot", 10, 100),
]
FOUL_SHARE_NAMES = ["foul_pct_WRT_x", "foul_pct_WRT_y"]

# --- event kinds averaged over a player's matches ---------------------------
SEASON_SPECS = [
    EventSpec("assist", tag=301),
    EventSpec("gol", tag=101),
    EventSpec("yellow_card", tag=1702),
]

# --- pitch grid -------------------------------------------------------------
GRID_SIDE = 5
CELL_WIDTH = 20
CELLS = [f"{x}{y}" for x in range(GRID_SIDE) for y in range(GRID_SIDE)]

# --- published column names -------------------------------------------------
ACCURACY_COLUMNS = [
    "nome_squadra",
    "accuratezza_media_dei_passaggi",
    "standard_deviation_accuratezza_media_dei_passaggi",
]
TACKLE_COLUMNS = ["identificativo_calciatore", "nome_calciatore", "tackle_vinti"]
GRID_METRICS = ["frequenza_eventi", "frequenza_passaggi_accurati", "frequenza_tiri", "frequenza_falli_subiti"]
REPORT_COLUMNS = ["id_calciatore", "nome_calciatore", "nome_squadra", "wyrole", "numero_presenze"]

# --- feature names, in the published order ----------------------------------
PLAY_FEATURES = [
    "foul_pct_WRT_x", "accurate_pass_pct_WRP", "accurate_shot_pct_WRP", "duel_pct_WRT", "fk_corner_pct_WRT",
    "fk_cross_pct_WRT", "fk_shot_pct_WRT", "foul_pct_WRT_y", "interception_pct_WRT", "key_pass_pct_WRT",
    "offside_pct_WRT", "pass_cross_pct_WRT", "pass_high_pct_WRT", "pass_simple_pct_WRT", "pass_smart_pct_WRT",
    "shot_pct_WRT", "assist", "gol", "yellow_card", "posizione_media_x", "posizione_media_y", "standard_deviation",
    "height", "weight", "tempo_medio_tra_eventi", "ambidestro", "angle_mean", "angle_std",
]
FEATURES = PLAY_FEATURES + ["total_distance"] + CELLS

MEAN_FILLED = ["angle_mean", "height", "weight", "ambidestro"]

# --- columns scaled to [0, 1] before the role models ------------------------
SCALED_DF = [
    "standard_deviation", "posizione_media_x", "posizione_media_y", "angle_mean", "angle_std", "height", "weight",
    "yellow_card", "tempo_medio_tra_eventi", "total_distance",
]
SCALED_FW_MD = SCALED_DF[:-1] + ["gol", "assist", "total_distance"]

# --- role models: components kept, codes, names, known example players ------
ROLE_COMPONENTS = {"DF": 18, "FW": 20, "MD": 20}
ROLE_CODES = {
    "DF": ["DFB", "AFB", "BPD", "SWL", "STP"],
    "FW": ["EXW", "SKW", "CMF", "CYS", "TGM"],
    "MD": ["CDM", "BWM", "DPM", "BBM", "INM", "WDM", "RNR", "PMR", "FAN"],
}
ROLE_NAMES = {
    "DF": ["Defensive full-back", "Attacking full back", "Ball playing defender", "Sweeper/libero", "Stopper"],
    "FW": ["Explosive winger", "Skillful winger", "Complete forward", "Cynical striker", "Target man"],
    "MD": [
        "Cultured defensive midfielder", "Ball winning midfielder", "Defensive playmaker", "Box to box midfielder",
        "Inside midfielder", "Wide midfielder", "Runner", "Playmaker", "Flamboyant attacking midfielder",
    ],
}
ROLE_EXAMPLES = {
    "DF": [
        [21001, 248950, 20495], [70084, 25849, 135903], [20459, 3300, 3431], [130, 288663, 263432],
        [20461, 92966, 22883],
    ],
    "MD": [
        [37732, 20438, 625], [40726, 7965, 14903], [20443, 3543, 21315], [285109, 3318, 20879, 265865],
        [21171, 114, 286223], [20845, 22566, 20935], [116269, 190167], [3484, 21025, 21169], [213948, 21123, 15524],
    ],
    "FW": [
        [3313, 14812, 447804], [11063, 21077, 105334, 21385], [89186, 20479, 122], [206314, 3323],
        [14943, 8327, 22933],
    ],
}

# --- bins of the distance histogram per role --------------------------------
DISTANCE_BINS = {"DF": 15, "MD": 10, "FW": 10}

# --- first words of match labels that differ from the team name -------------
HOME_ALIASES = {"Hellas": "Hellas Verona"}
