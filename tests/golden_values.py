"""Published result numbers used as golden fixtures (numbers only)."""

# FIXED VALUES: confusion matrices and scalar metrics of four evaluated models
METRICS = {
    "baseline_product": {
        "matrix": [
            [1843, 144, 1, 21, 208, 15, 2, 3, 13],
            [161, 1853, 5, 119, 52, 11, 9, 5, 35],
            [0, 0, 150, 0, 0, 0, 0, 0, 0],
            [16, 91, 22, 2000, 5, 32, 4, 10, 70],
            [300, 59, 0, 10, 1853, 15, 1, 2, 10],
            [25, 13, 2, 32, 14, 2110, 1, 20, 33],
            [2, 0, 0, 0, 1, 4, 142, 1, 0],
            [8, 12, 1, 74, 5, 14, 5, 2112, 19],
            [21, 48, 3, 128, 5, 32, 9, 13, 1991],
        ],
        "accuracy": 0.8756386292834891,
        "precision_macro": 0.8652290990019479,
        "recall_macro": 0.8959012345679012,
        "f1_macro": 0.8787445428540714,
        "f1_weighted": 0.8761314529222303,
    },
    "baseline_issue_group": {
        "matrix": [
            [1580, 263, 50, 102, 178, 160, 139, 85],
            [151, 967, 17, 37, 28, 70, 27, 33],
            [36, 26, 391, 71, 18, 17, 131, 15],
            [59, 41, 125, 522, 33, 76, 193, 38],
            [148, 45, 79, 49, 5095, 105, 326, 17],
            [97, 79, 5, 61, 81, 530, 4, 77],
            [55, 33, 192, 142, 153, 10, 1175, 7],
            [201, 147, 59, 93, 11, 194, 29, 1072],
        ],
        "accuracy": 0.7060436137071651,
        "precision_macro": 0.6172701006745184,
        "recall_macro": 0.6343335637535268,
        "f1_macro": 0.6208086135647649,
        "f1_weighted": 0.7106983693591544,
    },
    "bilstm_attention_product": {
        "matrix": [
            [1880, 127, 0, 14, 188, 16, 0, 8, 17],
            [212, 1800, 0, 138, 45, 19, 2, 10, 24],
            [0, 0, 150, 0, 0, 0, 0, 0, 0],
            [34, 96, 2, 1967, 8, 36, 1, 23, 83],
            [381, 43, 0, 15, 1778, 11, 1, 8, 13],
            [35, 17, 0, 26, 16, 2090, 1, 35, 30],
            [2, 0, 0, 0, 0, 4, 136, 4, 4],
            [13, 14, 0, 41, 3, 14, 4, 2141, 20],
            [23, 56, 0, 115, 11, 29, 10, 28, 1978],
        ],
        "accuracy": 0.8672897196261682,
        "precision_macro": 0.8831607678368776,
        "recall_macro": 0.8851358024691359,
        "f1_macro": 0.8834069855833666,
        "f1_weighted": 0.8679197419056376,
    },
    "distilbert_product": {
        "matrix": [
            [1888, 99, 0, 20, 206, 16, 3, 5, 13],
            [181, 1844, 0, 121, 51, 6, 8, 7, 32],
            [0, 0, 150, 0, 0, 0, 0, 0, 0],
            [25, 96, 4, 1980, 6, 32, 10, 19, 78],
            [282, 39, 0, 10, 1892, 8, 4, 2, 13],
            [22, 11, 0, 30, 5, 2129, 5, 20, 28],
            [1, 1, 0, 2, 3, 7, 126, 1, 9],
            [7, 7, 0, 42, 4, 16, 2, 2157, 15],
            [18, 38, 0, 89, 3, 27, 4, 14, 2057],
        ],
        "accuracy": 0.8861682242990654,
        "precision_macro": 0.8850123695573822,
        "recall_macro": 0.8931851851851851,
        "f1_macro": 0.8887138018092795,
        "f1_weighted": 0.8864755276904318,
    },
}

# FIXED VALUES: validation history of the recurrent model (10 epochs)
HISTORY = {
    "train_loss": [0.9970628639311593, 0.5063364185693268, 0.3878825312892649, 0.3161287515293135, 0.2707086456780918, 0.23374903621278872, 0.19746845432451474, 0.14002436793256348, 0.11006194450428712, 0.08994462756780741],
    "val_loss": [0.5399339979014293, 0.46151873062704213, 0.40969584837880835, 0.38588396038221795, 0.39612411499023437, 0.38734446223279767, 0.40542977110247747, 0.4684229766394119, 0.4961801063977298, 0.5705385939131644],
    "val_f1_macro": [0.7619305304061751, 0.8209928236464505, 0.8710427020620768, 0.8624979591880041, 0.8800500956140739, 0.8803280934303436, 0.8854930955698624, 0.8839741709084847, 0.8825024406552289, 0.8769401406274939],
    "val_accuracy": [0.8206853582554517, 0.8501557632398754, 0.8631152647975078, 0.861183800623053, 0.8649844236760125, 0.867601246105919, 0.8676635514018691, 0.8661682242990654, 0.8630529595015576, 0.8576947040498443],
}

# FIXED VALUES: rounded comparison table rows (accuracy, P macro, R macro, F1 macro, F1 weighted)
COMPARISON = [
    [0.8756, 0.8652, 0.8959, 0.8787, 0.8761],
    [0.8673, 0.8832, 0.8851, 0.8834, 0.8679],
    [0.8862, 0.885, 0.8932, 0.8887, 0.8865],
]
