"""The recapture / injury rows and the matching release rows
of the reference's PIT study (date, site, treatment, release time, sample
time, tag id, hemoglobin text, scale-loss class), copied as literals.
Site spelling, the archimedes2 typo and blank hemoglobin cells are kept as
recorded."""

RECAPTURES = [
    ("2024-05-06", "hatchery", "baseline", "12:30", "12:30", "na", "112", 0),
    ("2024-05-06", "hatchery", "baseline", "12:30", "12:30", "na", "85", 0),
    ("2024-05-23", "hammerlsey", "control", "11:40", "11:50", "f9c3", "109", 0),
    ("2024-05-23", "hammerlsey", "control", "11:40", "12:00", "fa99", "94", 0),
    ("2024-05-23", "hammerlsey", "control", "11:40", "12:05", "f981", "", 1),
    ("2024-05-23", "hammerlsey", "control", "11:40", "12:12", "fd87", "84", 0),
    ("2024-05-23", "hammerlsey", "control", "11:40", "12:17", "fdee", "95", 0),
    ("2024-05-23", "hammerlsey", "control", "11:40", "12:20", "f8ed", "", 0),
    ("2024-05-23", "hammerlsey", "control", "11:40", "12:22", "f99b", "84", 0),
    ("2024-05-23", "hammerlsey", "control", "11:40", "12:27", "fe68", "83", 0),
    ("2024-05-23", "hammerlsey", "control", "11:40", "12:31", "fcb0", "86", 0),
    ("2024-05-23", "hammerlsey", "control", "11:40", "12:37", "fde0", "", 1),
    ("2024-05-23", "hammerlsey", "control", "11:40", "12:40", "fa1c", "57", 0),
    ("2024-05-23", "hammerlsey", "archimedes1", "13:20", "13:34", "fe10", "89", 3),
    ("2024-05-23", "hammerlsey", "archimedes1", "13:20", "13:34", "f953", "87", 3),
    ("2024-05-23", "hammerlsey", "archimedes1", "13:20", "13:39", "fc73", "66", 0),
    ("2024-05-23", "hammerlsey", "archimedes1", "13:20", "13:54", "fc41", "", 1),
    ("2024-05-23", "hammerlsey", "archimedes1", "13:20", "13:56", "fc2b", "91", 0),
    ("2024-05-23", "hammerlsey", "archimedes1", "13:20", "14:01", "fe65", "", 1),
    ("2024-05-24", "hammerlsey", "archmiedes2", "9:55", "10:26", "fad7", "67", 0),
    ("2024-05-24", "hammerlsey", "archmiedes2", "9:55", "10:28", "fc64", "89", 0),
    ("2024-05-24", "hammerlsey", "archmiedes2", "9:55", "10:29", "fd9c", "", 1),
    ("2024-05-24", "hammerlsey", "archmiedes2", "9:55", "10:35", "fbbb", "79", 0),
    ("2024-05-24", "hammerlsey", "archmiedes2", "9:55", "10:39", "fc0a", "75", 0),
    ("2024-05-24", "hammerlsey", "archmiedes2", "9:55", "10:40", "fd53", "78", 0),
    ("2024-05-24", "hammerlsey", "archmiedes2", "9:55", "10:46", "f9c7", "78", 0),
    ("2024-05-24", "hammerlsey", "archmiedes2", "9:55", "10:49", "fa01", "85", 0),
    ("2024-05-24", "hammerlsey", "archmiedes2", "9:55", "10:51", "fd99", "77", 0),
    ("2024-05-24", "hammerlsey", "archimedes3", "12:08", "12:21", "fc29", "70", 0),
    ("2024-05-24", "hammerlsey", "archimedes3", "12:08", "12:26", "fd8f", "79", 2),
    ("2024-05-24", "hammerlsey", "archimedes3", "12:08", "12:30", "fdd6", "80", 1),
    ("2024-05-24", "hammerlsey", "archimedes3", "12:08", "12:33", "fb65", "79", 1),
    ("2024-05-24", "hammerlsey", "archimedes3", "12:08", "12:37", "fc95", "82", 0),
    ("2024-05-24", "hammerlsey", "archimedes3", "12:08", "12:41", "fc30", "74", 1),
    ("2024-05-24", "hammerlsey", "archimedes3", "12:08", "12:44", "f9c0", "68", 0),
    ("2024-05-24", "hammerlsey", "archimedes3", "12:08", "12:47", "fbda", "81", 0),
    ("2024-05-24", "hammerlsey", "archimedes3", "12:08", "12:58", "f938", "64", 0),
]

# (release date, release time as recorded in its file, tag id, treatment)
RELEASES = [
    ("2024-05-23", "11:40", "f9c3", "control"), ("2024-05-23", "11:40", "f8ed", "control"),
    ("2024-05-23", "11:40", "fa1c", "control"), ("2024-05-23", "11:40", "fcb0", "control"),
    ("2024-05-23", "11:40", "f99b", "control"), ("2024-05-23", "11:40", "fc73", "control"),
    ("2024-05-23", "11:40", "fa99", "control"), ("2024-05-23", "11:40", "f981", "control"),
    ("2024-05-23", "11:40", "fdee", "control"), ("2024-05-23", "11:40", "fe68", "control"),
    ("2024-05-23", "11:40", "fde0", "control"), ("2024-05-23", "11:40", "fd87", "control"),
    ("2024-05-23", "13:20", "f953", "archimedes1"), ("2024-05-23", "13:20", "fc41", "archimedes1"),
    ("2024-05-23", "13:20", "fc2b", "archimedes1"), ("2024-05-23", "13:20", "fe10", "archimedes1"),
    ("2024-05-23", "13:20", "fe65", "archimedes1"),
    ("2024-05-24", "9:55:00 AM", "fd99", "archimedes2"), ("2024-05-24", "9:55:00 AM", "fd9c", "archimedes2"),
    ("2024-05-24", "9:55:00 AM", "fad7", "archimedes2"), ("2024-05-24", "9:55:00 AM", "f9c7", "archimedes2"),
    ("2024-05-24", "9:55:00 AM", "f9c0", "archimedes2"), ("2024-05-24", "9:55:00 AM", "fa01", "archimedes2"),
    ("2024-05-24", "9:55:00 AM", "fc0a", "archimedes2"), ("2024-05-24", "9:55:00 AM", "fc64", "archimedes2"),
    ("2024-05-24", "9:55:00 AM", "fbbb", "archimedes2"),
    ("2024-05-24", "9:45:20 AM", "fc29", "archimedes2"), ("2024-05-24", "9:45:20 AM", "fd53", "archimedes2"),
    ("2024-05-24", "12:08", "fdd6", "archimedes3"), ("2024-05-24", "12:08", "fc95", "archimedes3"),
    ("2024-05-24", "12:08", "f938", "archimedes3"), ("2024-05-24", "12:08", "fd8f", "archimedes3"),
    ("2024-05-24", "12:08", "fc30", "archimedes3"), ("2024-05-24", "12:08", "fb65", "archimedes3"),
    ("2024-05-24", "12:08", "fbda", "archimedes3"),
]

# Recorded outcome of the reference pipeline
MATCHED, WITHIN_60, FINAL = 35, 31, 26
FINAL_BY_GROUP = {"control": 10, "archimedes": 16}
HEMOGLOBIN = {"archimedes": (15, 77.8), "control": (7, 90.7142857)}
WELCH_T, WELCH_DF = -3.29722, 8.5370
SCALE_LOSS = {("control", 0): 8, ("control", 1): 2, ("pump", 0): 11, ("pump", 1): 4, ("pump", 2): 1}
