"""Names of running programs and devices matched to known profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.functions.media import literal_map

# Fixed values: (profile, tokens); the order is the priority.
APP_PROFILES = [
    ("Logic Pro", ["logic pro", "logic pro x"]),
    ("Ableton Live", ["ableton live"]),
    ("Pro Tools", ["pro tools"]),
    ("FL Studio", ["fl studio"]),
    ("Studio One", ["studio one"]),
    ("Cubase", ["cubase"]),
    ("Nuendo", ["nuendo"]),
    ("REAPER", ["reaper"]),
    ("Bitwig Studio", ["bitwig studio", "bitwig"]),
    ("GarageBand", ["garageband"]),
    ("Adobe Audition", ["adobe audition", "audition"]),
    ("Reason", ["reason"]),
    ("Ardour", ["ardour"]),
    ("Renoise", ["renoise"]),
    ("LMMS", ["lmms"]),
    ("Cakewalk", ["cakewalk", "sonar"]),
    ("Tracktion Waveform", ["waveform", "tracktion"]),
    ("Samplitude / Sequoia", ["samplitude", "sequoia"]),
    ("Akai MPC Desktop / MPC Beats", ["mpc beats", "mpc software", "mpc"]),
    ("Serato Studio", ["serato studio"]),
    ("Native Instruments Maschine", ["maschine 3", "maschine 2", "maschine"]),
]
PROCESS_ONLY = [
    ("Serato DJ Pro", ["serato dj pro"]),
    ("Serato DJ Lite", ["serato dj lite"]),
]
HARDWARE_PROFILES = [
    ("Akai MPC Key 61", ["mpc key 61"]),
    ("Akai MPC Key 37", ["mpc key 37"]),
    ("Akai MPC X / X SE", ["mpc x se", "mpc x"]),
    ("Akai MPC Live II", ["mpc live ii", "mpc live 2", "mpc live"]),
    ("Akai MPC One / One+", ["mpc one+", "mpc one plus", "mpc one"]),
    ("Akai MPC Studio", ["mpc studio"]),
    ("Akai MPC Touch", ["mpc touch"]),
    ("Native Instruments Maschine+", ["maschine+", "maschine plus"]),
    ("Native Instruments Maschine", ["maschine mk3", "maschine mikro", "maschine"]),
    ("Ableton Push 3", ["push 3", "ableton push"]),
    ("Ableton Move", ["ableton move", "move"]),
    ("Roland FANTOM / FANTOM EX", ["fantom ex", "fantom-06", "fantom-07", "fantom-08", "fantom"]),
    ("Yamaha MONTAGE M", ["montage m8x", "montage m7", "montage m6", "montage m"]),
    ("Yamaha MODX+", ["modx8+", "modx7+", "modx6+", "modx+", "modx"]),
    ("Korg NAUTILUS", ["nautilus"]),
    ("Korg KRONOS", ["kronos"]),
    ("Roland MC-707", ["mc-707", "mc707"]),
    ("Roland MC-101", ["mc-101", "mc101"]),
    ("Novation Circuit Tracks", ["circuit tracks"]),
    ("Novation Circuit Rhythm", ["circuit rhythm"]),
    ("Elektron Digitakt", ["digitakt ii", "digitakt"]),
    ("Elektron Octatrack", ["octatrack mkii", "octatrack"]),
]

# File extensions of each program's projects.
PROJECT_EXTENSIONS = {
    "Logic Pro": ".logicx",
    "Ableton Live": ".als",
    "Pro Tools": ".ptx|.ptf",
    "FL Studio": ".flp",
    "Studio One": ".song",
    "Cubase": ".cpr",
    "Nuendo": ".npr",
    "REAPER": ".rpp",
    "Bitwig Studio": ".bwproject",
    "GarageBand": ".band",
    "Adobe Audition": ".sesx",
    "Reason": ".reason",
    "Ardour": ".ardour",
    "Renoise": ".xrns",
    "LMMS": ".mmp|.mmpz",
    "Cakewalk": ".cwp",
    "Tracktion Waveform": ".tracktionedit",
    "Samplitude / Sequoia": ".vip",
    "Akai MPC Desktop / MPC Beats": ".xpj",
    "Serato Studio": ".ssp",
    "Native Instruments Maschine": ".mxprj|.mprj",
}
# Category of each device.
HARDWARE_CATEGORIES = {
    "Akai MPC Key 61": "standalone_production_keyboard",
    "Akai MPC Key 37": "standalone_production_keyboard",
    "Akai MPC X / X SE": "standalone_mpc",
    "Akai MPC Live II": "standalone_mpc",
    "Akai MPC One / One+": "standalone_mpc",
    "Akai MPC Studio": "mpc_controller",
    "Akai MPC Touch": "mpc_controller",
    "Native Instruments Maschine+": "standalone_groovebox",
    "Native Instruments Maschine": "production_controller",
    "Ableton Push 3": "standalone_production_controller",
    "Ableton Move": "standalone_production_instrument",
    "Roland FANTOM / FANTOM EX": "music_workstation",
    "Yamaha MONTAGE M": "music_workstation",
    "Yamaha MODX+": "music_workstation",
    "Korg NAUTILUS": "music_workstation",
    "Korg KRONOS": "music_workstation",
    "Roland MC-707": "groovebox",
    "Roland MC-101": "groovebox",
    "Novation Circuit Tracks": "groovebox",
    "Novation Circuit Rhythm": "groovebox",
    "Elektron Digitakt": "groovebox_sampler",
    "Elektron Octatrack": "performance_sampler",
}


def of_profile(profile: Column, values: dict[str, str]) -> Column:
    """What is known of a matched profile; null for no match."""
    return F.try_element_at(literal_map(values), profile)


def normalized_name(col: Column) -> Column:
    bare = F.replace(F.replace(F.lower(col), F.lit(".app"), F.lit("")), F.lit("_"), F.lit(" "))
    return F.regexp_replace(text.stripped(bare), "\\s+", " ")


def dictionary_match(name: Column, profiles: list[tuple[str, list[str]]]) -> Column:
    """First profile, in catalogue order, one of whose tokens occurs in the name."""
    plain = normalized_name(name)
    found = F
    for profile, tokens in profiles:
        hit = F.lit(False)
        for token in tokens:
            hit = hit | plain.contains(token)
        found = found.when(hit, F.lit(profile))
    return found
