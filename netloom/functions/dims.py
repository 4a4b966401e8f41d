"""Names, templates, labels, patterns, word lists. They must equal the published ones.

Profiles: "annotation" (detections shown to annotators), "wiring" (full wiring run), "reading"
(value reading) and "segments" (wire segments). All tables here have a fixed size below 200 rows,
so their DataFrames are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# ---- fixed values: canonical names --------------------------------------------------------------
NAMES = {
    "wiring": {
        "resistor": "Resistor", "capacitor.unpolarized": "Capacitor",
        "capacitor.polarized": "Polarized-Capacitor", "capacitor.adjustable": "Capacitor",
        "inductor": "Inductor", "inductor.ferrite": "Inductor",
        "diode": "Diode", "diode.light_emitting": "LED", "diode.zener": "Zener Diode",
        "diode.thyrector": "Diode", "voltage.dc": "V-DC", "voltage.ac": "V-AC",
        "voltage.battery": "Battery", "gnd": "GND", "vss": "GND",
        "transistor.bjt": "BJT-PNP", "transistor.fet": "MOSFET-P", "operational_amplifier": "Op-Amp",
        "thyristor": "Thyristor", "triac": "Triac", "diac": "Diac", "varistor": "Varistor",
        "lamp": "Lamp", "resistor.adjustable": "Potentiometer", "resistor.photo": "Photo-Resistor",
        "inductor.coupled": "Transformer", "transformer": "Transformer",
        "operational_amplifier.schmitt_trigger": "Schmitt-Trigger", "optocoupler": "Optocoupler",
        "integrated_circuit": "IC", "integrated_circuit.ne555": "NE555",
        "integrated_circuit.voltage_regulator": "Voltage-Regulator",
        "transistor.photo": "Photo-Transistor",
        "xor": "XOR", "and": "AND", "or": "OR", "not": "NOT", "nand": "NAND", "nor": "NOR",
        "switch": "Switch", "relay": "Relay", "socket": "Socket", "fuse": "Fuse",
        "speaker": "Speaker", "motor": "Motor", "microphone": "Microphone", "antenna": "Antenna",
        "crystal": "Crystal", "mechanical": "Mechanical", "magnetic": "Magnetic",
        "optical": "Optical", "block": "Block", "explanatory": "Explanatory", "unknown": "Unknown",
    },
    "annotation": {
        "resistor": "Resistor", "resistor.adjustable": "Potentiometer",
        "capacitor.unpolarized": "Capacitor", "capacitor.polarized": "Polarized-Capacitor",
        "capacitor.adjustable": "Variable-Capacitor",
        "inductor": "Inductor", "inductor.ferrite": "Inductor", "diode": "Diode",
        "diode.light_emitting": "LED", "diode.zener": "Zener-Diode", "diode.thyrector": "Diac",
        "voltage.dc": "V-DC", "voltage.ac": "V-AC", "current.dc": "I-DC", "current.ac": "I-AC",
        "voltage.battery": "Battery", "gnd": "GND", "vss": "GND", "switch": "Switch",
        "speaker": "Speaker", "transistor.bjt": "BJT", "transistor.fet": "FET",
        "transistor.photo": "PhotoTransistor", "integrated_circuit": "IC",
        "integrated_circuit.ne555": "NE555",
        "integrated_circuit.voltage_regulator": "Voltage-Regulator",
        "op_amp": "Op-Amp", "schmitt_trigger": "Schmitt-Trigger", "optocoupler": "Optocoupler",
        "explanatory": "Explanatory", "terminal": "Terminal", "operational_amplifier": "Op-Amp",
        "lamp": "Lamp", "relay": "Relay", "thyristor": "Thyristor", "motor": "Motor",
    },
    "reading": {
        "resistor": "Resistor", "capacitor.unpolarized": "Capacitor",
        "capacitor.polarized": "Capacitor", "capacitor.adjustable": "Capacitor",
        "inductor": "Inductor", "inductor.ferrite": "Inductor",
        "diode": "Diode", "diode.light_emitting": "Diode", "diode.zener": "Zener Diode",
        "diode.thyrector": "Diode", "voltage.dc": "V-DC", "voltage.ac": "V-AC",
        "voltage.battery": "V-DC", "gnd": "GND", "vss": "GND",
        "transistor.bjt": "BJT-PNP", "transistor.fet": "MOSFET-P", "operational_amplifier": "Op-Amp",
        "thyristor": "Thyristor", "triac": "Triac", "diac": "Diac", "varistor": "Varistor",
    },
}

# ---- fixed values: short display codes ----------------------------------------------------------
DISPLAY = {
    "wiring": {
        "resistor": "R", "capacitor.unpolarized": "C", "capacitor.polarized": "Cp", "inductor": "L",
        "diode": "D", "diode.light_emitting": "LED", "diode.zener": "ZD", "voltage.dc": "Vdc",
        "voltage.ac": "Vac", "gnd": "GND", "transistor.bjt": "BJT", "transistor.fet": "FET",
        "operational_amplifier": "OpAmp", "thyristor": "SCR", "triac": "TRIAC", "diac": "DIAC",
        "varistor": "VDR", "lamp": "Lamp", "resistor.adjustable": "RP", "resistor.photo": "Rph",
        "inductor.coupled": "TX", "transformer": "TX",
        "operational_amplifier.schmitt_trigger": "Sch", "optocoupler": "OC",
        "integrated_circuit": "IC", "integrated_circuit.ne555": "555",
        "integrated_circuit.voltage_regulator": "VR", "transistor.photo": "Qph",
        "xor": "XOR", "and": "AND", "or": "OR", "not": "NOT", "nand": "NAND", "nor": "NOR",
        "switch": "SW", "relay": "K", "socket": "J", "fuse": "F", "speaker": "SP", "motor": "M",
        "microphone": "MIC", "antenna": "ANT", "crystal": "XTAL", "mechanical": "MECH",
        "magnetic": "MAG", "optical": "OPT", "block": "BLK", "explanatory": "EXP", "unknown": "UNK",
    },
    "reading": {
        "resistor": "R", "capacitor.unpolarized": "C", "capacitor.polarized": "Cp", "inductor": "L",
        "diode": "D", "diode.light_emitting": "LED", "diode.zener": "ZD", "voltage.dc": "Vdc",
        "voltage.ac": "Vac", "gnd": "GND", "transistor.bjt": "BJT", "transistor.fet": "FET",
        "operational_amplifier": "OpAmp", "thyristor": "SCR", "triac": "TRIAC", "diac": "DIAC",
        "varistor": "VDR",
    },
}

# ---- fixed values: class -> port key where it differs from the canonical name ---------------------
PORT_KEYS = {
    "wiring": {c: n for c, n in NAMES["wiring"].items()},
    "reading": {
        "resistor": "Resistor", "resistor.adjustable": "Resistor",
        "capacitor.unpolarized": "Capacitor", "capacitor.polarized": "Capacitor",
        "inductor": "Inductor", "inductor.ferrite": "Inductor",
        "diode": "Diode", "diode.light_emitting": "Diode", "diode.zener": "Zener Diode",
        "diode.thyrector": "Diode", "voltage.dc": "V-DC", "voltage.ac": "V-AC",
        "gnd": "GND", "vss": "GND", "transistor.bjt": "BJT-PNP", "transistor.fet": "MOSFET-P",
        "operational_amplifier": "Op-Amp", "thyristor": "Thyristor", "triac": "Triac",
        "diac": "Diac", "varistor": "Varistor",
    },
}

# ---- fixed values: port templates, relative to the box (0 left/top, 1 right/bottom) -----------------
TEMPLATES = {
    "wiring": {
        "Resistor": ((0.0, 0.5), (1.0, 0.5)),
        "Capacitor": ((0.0, 0.5), (1.0, 0.5)),
        "Polarized-Capacitor": ((0.0, 0.5), (1.0, 0.5)),
        "Inductor": ((0.0, 0.5), (1.0, 0.5)),
        "Diode": ((0.0, 0.5), (1.0, 0.5)),
        "LED": ((0.0, 0.5), (1.0, 0.5)),
        "Zener Diode": ((0.0, 0.5), (1.0, 0.5)),
        "Thyristor": ((0.0, 0.5), (1.0, 0.5)),
        "Triac": ((0.0, 0.5), (1.0, 0.5)),
        "Diac": ((0.0, 0.5), (1.0, 0.5)),
        "Varistor": ((0.0, 0.5), (1.0, 0.5)),
        "V-DC": ((0.5, 0.0), (0.5, 1.0)),
        "V-AC": ((0.5, 0.0), (0.5, 1.0)),
        "I-DC": ((0.5, 0.0), (0.5, 1.0)),
        "I-AC": ((0.5, 0.0), (0.5, 1.0)),
        "GND": ((0.5, 0.0),),
        "BJT-NPN": ((0.0, 0.5), (0.7, 0.0), (0.7, 1.0)),
        "BJT-PNP": ((0.0, 0.5), (0.7, 0.0), (0.7, 1.0)),
        "MOSFET-N": ((0.0, 0.5), (0.5, 1.0), (0.5, 0.0)),
        "MOSFET-P": ((0.0, 0.5), (0.5, 1.0), (0.5, 0.0)),
        "Op-Amp": ((0.0, 0.5), (0.0, 0.3), (1.0, 0.5)),
        "Lamp": ((0.0, 0.5), (1.0, 0.5)),
        "Potentiometer": ((0.0, 0.5), (1.0, 0.5), (0.5, 1.0)),
        "Photo-Resistor": ((0.0, 0.5), (1.0, 0.5)),
        "Transformer": ((0.0, 0.5), (1.0, 0.5), (0.0, 0.2), (1.0, 0.2)),
        "Schmitt-Trigger": ((0.0, 0.5), (0.0, 0.3), (1.0, 0.5)),
        "Optocoupler": ((0.0, 0.5), (1.0, 0.5), (0.0, 0.8), (1.0, 0.8)),
        "IC": ((0.0, 0.3), (0.0, 0.7), (1.0, 0.5)),
        "NE555": ((0.0, 0.2), (0.0, 0.4), (0.0, 0.6), (0.0, 0.8), (1.0, 0.5), (0.5, 1.0), (0.5, 0.0), (1.0, 0.3)),
        "Voltage-Regulator": ((0.0, 0.5), (1.0, 0.5), (0.5, 0.0)),
        "Photo-Transistor": ((0.5, 1.0), (0.5, 0.0)),
        "XOR": ((0.0, 0.5), (1.0, 0.5), (0.5, 0.0)),
        "AND": ((0.0, 0.5), (1.0, 0.5), (0.5, 0.0)),
        "OR": ((0.0, 0.5), (1.0, 0.5), (0.5, 0.0)),
        "NOT": ((0.0, 0.5), (1.0, 0.5), (0.5, 0.0)),
        "NAND": ((0.0, 0.5), (1.0, 0.5), (0.5, 0.0)),
        "NOR": ((0.0, 0.5), (1.0, 0.5), (0.5, 0.0)),
        "Switch": ((0.0, 0.5), (1.0, 0.5)),
        "Relay": ((0.0, 0.3), (0.0, 0.7), (1.0, 0.5)),
        "Socket": ((0.0, 0.5), (1.0, 0.5)),
        "Fuse": ((0.0, 0.5), (1.0, 0.5)),
        "Speaker": ((0.0, 0.5), (1.0, 0.5)),
        "Motor": ((0.0, 0.5), (1.0, 0.5)),
        "Microphone": ((0.0, 0.5), (1.0, 0.5)),
        "Antenna": ((0.5, 0.0),),
        "Crystal": ((0.0, 0.5), (1.0, 0.5)),
        "Mechanical": ((0.0, 0.5), (1.0, 0.5)),
        "Magnetic": ((0.0, 0.5), (1.0, 0.5)),
        "Optical": ((0.0, 0.5), (1.0, 0.5)),
        "Block": ((0.0, 0.5), (1.0, 0.5)),
        "Explanatory": (),
        "Unknown": (),
        "Wire Crossover": (),
    },
    "annotation": {
        "Resistor": ((0.0, 0.5), (1.0, 0.5)),
        "Potentiometer": ((0.0, 0.5), (1.0, 0.5), (0.5, 0.0)),
        "Capacitor": ((0.0, 0.5), (1.0, 0.5)),
        "Polarized-Capacitor": ((0.0, 0.5), (1.0, 0.5)),
        "Inductor": ((0.0, 0.5), (1.0, 0.5)),
        "Diode": ((0.0, 0.5), (1.0, 0.5)),
        "LED": ((0.0, 0.5), (1.0, 0.5)),
        "Zener-Diode": ((0.0, 0.5), (1.0, 0.5)),
        "V-DC": ((0.5, 0.0), (0.5, 1.0)),
        "V-AC": ((0.5, 0.0), (0.5, 1.0)),
        "I-DC": ((0.5, 0.0), (0.5, 1.0)),
        "I-AC": ((0.5, 0.0), (0.5, 1.0)),
        "Battery": ((0.5, 0.0), (0.5, 1.0)),
        "GND": ((0.5, 0.0),),
        "Switch": ((0.0, 0.5), (1.0, 0.5)),
        "Speaker": ((0.0, 0.5), (1.0, 0.5)),
        "BJT": ((0.0, 0.5), (0.7, 0.0), (0.7, 1.0)),
        "Diac": ((0.0, 0.5), (1.0, 0.5)),
        "Variable-Capacitor": ((0.0, 0.5), (1.0, 0.5)),
        "Terminal": ((0.5, 0.5),),
        "Explanatory": (),
        "Op-Amp": ((0.0, 0.15), (0.0, 0.85), (1.0, 0.5), (0.5, 0.0), (0.5, 1.0)),
        "Lamp": ((0.0, 0.5), (1.0, 0.5)),
        "PhotoTransistor": ((0.5, 0.0), (0.5, 1.0)),
        "FET": ((0.0, 0.5), (0.5, 0.0), (0.5, 1.0)),
        "Relay": ((0.0, 0.5), (1.0, 0.5), (0.5, 0.0), (0.5, 1.0)),
        "Thyristor": ((0.0, 0.5), (1.0, 0.5)),
        "Motor": ((0.0, 0.5), (1.0, 0.5)),
        "Transformer": ((0.0, 0.2), (0.0, 0.8), (1.0, 0.2), (1.0, 0.8)),
    },
    "reading": {
        "Resistor": ((0.0, 0.5), (1.0, 0.5)),
        "Capacitor": ((0.0, 0.5), (1.0, 0.5)),
        "Inductor": ((0.0, 0.5), (1.0, 0.5)),
        "Diode": ((0.0, 0.5), (1.0, 0.5)),
        "Zener Diode": ((0.0, 0.5), (1.0, 0.5)),
        "Thyristor": ((0.0, 0.5), (1.0, 0.5)),
        "Triac": ((0.0, 0.5), (1.0, 0.5)),
        "Diac": ((0.0, 0.5), (1.0, 0.5)),
        "Varistor": ((0.0, 0.5), (1.0, 0.5)),
        "V-DC": ((0.5, 1.0), (0.5, 0.0)),
        "V-AC": ((0.5, 1.0), (0.5, 0.0)),
        "I-DC": ((0.5, 1.0), (0.5, 0.0)),
        "I-AC": ((0.5, 1.0), (0.5, 0.0)),
        "GND": ((0.5, 0.0),),
        "BJT-NPN": ((0.0, 0.5), (0.7, 1.0), (0.7, 0.0)),
        "BJT-PNP": ((0.0, 0.5), (0.7, 1.0), (0.7, 0.0)),
        "MOSFET-N": ((0.0, 0.5), (0.5, 1.0), (0.5, 0.0)),
        "MOSFET-P": ((0.0, 0.5), (0.5, 1.0), (0.5, 0.0)),
        "Op-Amp": ((0.0, 0.5), (0.0, 0.3), (1.0, 0.5)),
        "Wire Crossover": (),
    },
    "segments": {
        "Resistor": ((0.0, 0.5), (1.0, 0.5)),
        "Capacitor": ((0.0, 0.5), (1.0, 0.5)),
        "Inductor": ((0.0, 0.5), (1.0, 0.5)),
        "Diode": ((0.0, 0.5), (1.0, 0.5)),
        "Zener Diode": ((0.0, 0.5), (1.0, 0.5)),
        "V-DC": ((0.5, 1.0), (0.5, 0.0)),
        "V-AC": ((0.5, 1.0), (0.5, 0.0)),
        "I-DC": ((0.5, 1.0), (0.5, 0.0)),
        "I-AC": ((0.5, 1.0), (0.5, 0.0)),
        "GND": ((0.5, 0.0),),
        "BJT-NPN": ((0.0, 0.5), (0.7, 1.0), (0.7, 0.0)),
        "BJT-PNP": ((0.0, 0.5), (0.7, 1.0), (0.7, 0.0)),
        "MOSFET-N": ((0.0, 0.5), (0.5, 1.0), (0.5, 0.0)),
        "MOSFET-P": ((0.0, 0.5), (0.5, 1.0), (0.5, 0.0)),
        "Op-Amp": ((0.0, 0.5), (0.0, 0.3), (1.0, 0.5)),
        "Wire Crossover": (),
    },
}
TYPES_WITH_SCANNED_PINS = ("IC", "NE555", "Voltage-Regulator", "Op-Amp", "Schmitt-Trigger", "Optocoupler")

# ---- fixed values: port labels ------------------------------------------------------------------
LABELS = {
    "wiring": {
        "Resistor": ("1", "2"),
        "Capacitor": ("1", "2"),
        "Polarized-Capacitor": ("+", "-"),
        "Inductor": ("1", "2"),
        "Diode": ("A", "K"),
        "LED": ("+", "-"),
        "Zener Diode": ("A", "K"),
        "Thyristor": ("A", "K"),
        "Triac": ("T1", "T2"),
        "Diac": ("T1", "T2"),
        "Varistor": ("1", "2"),
        "V-DC": ("+", "-"),
        "V-AC": ("~", "~"),
        "I-DC": ("-", "+"),
        "I-AC": ("~", "~"),
        "GND": ("GND",),
        "BJT-NPN": ("B", "E", "C"),
        "BJT-PNP": ("B", "E", "C"),
        "MOSFET-N": ("G", "S", "D"),
        "MOSFET-P": ("G", "S", "D"),
        "Op-Amp": ("-", "+", "OUT"),
        "Lamp": ("1", "2"),
        "Potentiometer": ("1", "2", "W"),
        "Photo-Resistor": ("1", "2"),
        "Transformer": ("P1", "P2", "S1", "S2"),
        "Schmitt-Trigger": ("-", "+", "OUT"),
        "Optocoupler": ("A", "K", "C", "E"),
        "IC": ("-", "+", "OUT"),
        "NE555": ("GND", "TRIG", "OUT", "RST", "CTRL", "THR", "DIS", "VCC"),
        "Voltage-Regulator": ("IN", "OUT", "GND"),
        "Photo-Transistor": ("C", "E"),
        "XOR": ("A", "B", "Y"),
        "AND": ("A", "B", "Y"),
        "OR": ("A", "B", "Y"),
        "NOT": ("A", "Y"),
        "NAND": ("A", "B", "Y"),
        "NOR": ("A", "B", "Y"),
        "Switch": ("1", "2"),
        "Relay": ("COIL1", "COIL2", "COM"),
        "Socket": ("1", "2"),
        "Fuse": ("1", "2"),
        "Speaker": ("1", "2"),
        "Motor": ("+", "-"),
        "Microphone": ("+", "-"),
        "Antenna": ("ANT",),
        "Crystal": ("1", "2"),
        "Mechanical": ("1", "2"),
        "Magnetic": ("1", "2"),
        "Optical": ("1", "2"),
        "Block": ("1", "2"),
        "Explanatory": (),
        "Unknown": (),
    },
    "annotation": {
        "Resistor": ("1", "2"),
        "Potentiometer": ("1", "2", "W"),
        "Capacitor": ("1", "2"),
        "Polarized-Capacitor": ("+", "-"),
        "Inductor": ("1", "2"),
        "Diode": ("+", "-"),
        "LED": ("+", "-"),
        "Zener-Diode": ("+", "-"),
        "V-DC": ("+", "-"),
        "V-AC": ("~", "~"),
        "I-DC": ("+", "-"),
        "I-AC": ("~", "~"),
        "Battery": ("+", "-"),
        "GND": ("GND",),
        "Switch": ("1", "2"),
        "Speaker": ("1", "2"),
        "BJT": ("B", "E", "C"),
        "Diac": ("1", "2"),
        "Variable-Capacitor": ("1", "2"),
        "Terminal": ("T",),
        "Explanatory": (),
        "Op-Amp": ("-", "+", "OUT", "V+", "V-"),
        "Lamp": ("1", "2"),
        "PhotoTransistor": ("C", "E"),
        "FET": ("G", "S", "D"),
        "Relay": ("C1", "C2", "NO", "COM"),
        "Thyristor": ("A", "K"),
        "Motor": ("1", "2"),
        "Transformer": ("P1", "P2", "S1", "S2"),
    },
}

# ---- fixed values: designator prefixes ------------------------------------------------------------
PREFIXES = {
    "wiring": {
        "Resistor": "R", "Capacitor": "C", "Polarized-Capacitor": "C", "Inductor": "L", "Diode": "D",
        "Zener Diode": "ZD", "LED": "LED", "V-DC": "V", "V-AC": "V", "I-DC": "I", "I-AC": "I",
        "GND": "GND", "BJT-NPN": "Q", "BJT-PNP": "Q", "MOSFET-N": "Q", "MOSFET-P": "Q", "Op-Amp": "U",
        "Thyristor": "SCR", "Triac": "TRIAC", "Diac": "DIAC", "Varistor": "VDR", "Lamp": "Lamp",
        "Potentiometer": "RP", "Photo-Resistor": "Rph", "Transformer": "TX", "Schmitt-Trigger": "U",
        "Optocoupler": "OC", "IC": "IC", "NE555": "U", "Voltage-Regulator": "VR",
        "Photo-Transistor": "Qph", "XOR": "U", "AND": "U", "OR": "U", "NOT": "U", "NAND": "U",
        "NOR": "U", "Switch": "SW", "Relay": "K", "Socket": "J", "Fuse": "F", "Speaker": "SP",
        "Motor": "M", "Microphone": "MIC", "Antenna": "ANT", "Crystal": "XTAL", "Mechanical": "MECH",
        "Magnetic": "MAG", "Optical": "OPT", "Block": "BLK", "Explanatory": "EXP", "Unknown": "UNK",
    },
    "annotation": {
        "Resistor": "R", "Potentiometer": "R", "Capacitor": "C", "Polarized-Capacitor": "C",
        "Inductor": "L", "Diode": "D", "LED": "L", "Zener-Diode": "ZD", "Diac": "DI", "V-DC": "V",
        "V-AC": "V", "I-DC": "I", "I-AC": "I", "Battery": "BAT", "GND": "GND", "Switch": "SW",
        "Speaker": "SP", "BJT": "Q", "FET": "Q", "PhotoTransistor": "Q", "IC": "U", "NE555": "U",
        "Voltage-Regulator": "U", "Op-Amp": "U", "Schmitt-Trigger": "U", "Optocoupler": "U",
        "Relay": "RL", "Thyristor": "TH", "Motor": "M", "Lamp": "LMP", "Terminal": "T",
        "Explanatory": "X", "Variable-Capacitor": "C", "Transformer": "T",
    },
}

# ---- fixed values: overlap families and specificity ---------------------------------------------
FAMILIES = {
    "annotation": (("diode", "diode.light_emitting", "diode.zener", "diode.thyrector"),
                   ("capacitor.unpolarized", "capacitor.polarized", "capacitor.adjustable"),
                   ("integrated_circuit", "integrated_circuit.ne555",
                    "integrated_circuit.voltage_regulator")),
    "wiring": (("diode", "diode.light_emitting", "diode.zener", "diode.thyrector"),
               ("voltage.dc", "voltage.ac", "voltage.battery"), ("gnd", "vss"),
               ("capacitor.unpolarized", "capacitor.polarized", "capacitor.adjustable"),
               ("integrated_circuit", "integrated_circuit.ne555",
                "integrated_circuit.voltage_regulator")),
}
SPECIFICITY = {"diode.light_emitting": 3, "diode.zener": 3, "diode.thyrector": 2, "diode": 1,
               "capacitor.polarized": 3, "capacitor.adjustable": 2, "capacitor.unpolarized": 1,
               "integrated_circuit.ne555": 3, "integrated_circuit.voltage_regulator": 3,
               "integrated_circuit": 1}

# ---- fixed values: filters ------------------------------------------------------------------------
SKIP = {"wiring": ("crossover", "probe.current", "probe.voltage"),
        "annotation": ("junction", "crossover", "text", "probe.current", "probe.voltage", "explanatory"),
        "reading": ("text", "junction", "crossover", "terminal")}
CONF = {"wiring": 0.40, "annotation": 0.40, "reading": 0.45}
JUNCTION_CONF = 0.10
NOT_COMPONENTS = ("junction", "crossover", "text", "probe.current", "probe.voltage")
RESISTIVE_LOADS = ("Resistor", "LED", "Diode", "Capacitor", "Inductor", "Op-Amp", "IC")

# ---- fixed values: value patterns -----------------------------------------------------------------
VALUE_PATTERNS = {
    "wiring": {
        "Resistor": (r"^[\d.]+[kKM]?\s*[Ω]?$", "Ω"),
        "Capacitor": (r"^[\d.]+[μunpUNPmM]?\s*F?$", "F"),
        "Polarized-Capacitor": (r"^[\d.]+[μunpUNPmM]?\s*F?$", "F"),
        "Inductor": (r"^[\d.]+[μumM]?\s*H?$", "H"),
        "V-DC": (r"^[\d.]+[μumM]?\s*V?$", "V"), "V-AC": (r"^[\d.]+[μumM]?\s*V?$", "V"),
        "I-DC": (r"^[\d.]+[μumM]?\s*A?$", "A"), "I-AC": (r"^[\d.]+[μumM]?\s*A?$", "A"),
    },
    "reading": {
        "Resistor": (r"^[\d.]+[kKM]?\s*[Ω]?$", "Ω"),
        "Capacitor": (r"^[\d.]+[μunpUNP]?\s*F?$", "F"),
        "Inductor": (r"^[\d.]+[μumM]?\s*H?$", "H"),
        "V-DC": (r"^[\d.]+[μumM]?\s*V?$", "V"), "V-AC": (r"^[\d.]+[μumM]?\s*V?$", "V"),
        "I-DC": (r"^[\d.]+[μumM]?\s*A?$", "A"), "I-AC": (r"^[\d.]+[μumM]?\s*A?$", "A"),
    },
}
ANTI_PATTERNS_READING = {
    "Diode": (r"[AVΩ]$", r"[Fμ]$", r"^[\d.]+\s*[FHz]$"),
    "Zener Diode": (r"[AVΩ]$", r"[Fμ]$", r"^[\d.]+\s*[FHz]$"),
    "GND": (r".*",), "Wire Crossover": (r".*",),
    "MOSFET-N": (r"[ΩFVHzμA]$",), "MOSFET-P": (r"[ΩFVHzμA]$",),
    "BJT-NPN": (r"[ΩFVHzμA]$",), "BJT-PNP": (r"[ΩFVHzμA]$",), "Op-Amp": (r"[ΩFVHzμA]$",),
    "Thyristor": (r"[ΩFVHzμA]$",), "Triac": (r"[ΩFVHzμA]$",), "Diac": (r"[ΩFVHzμA]$",),
    "Varistor": (r"[ΩFVHzμA]$",),
}
UNIT_END = r"[ΩFHVAmHμ]$"
VALID_UNITS = {"Resistor": ("Ω", "kΩ", "MΩ"), "Capacitor": ("F", "μF", "mF", "nF", "pF"),
               "Inductor": ("H", "mH", "μH"), "V-DC": ("V", "mV"), "V-AC": ("V", "mV"),
               "I-DC": ("A", "mA"), "I-AC": ("A", "mA")}
SURE_CONF = 0.60
NAMED_CHIPS = ("IC", "NE555", "Voltage-Regulator", "Optocoupler", "Op-Amp")

# ---- fixed values: alphabets ----------------------------------------------------------------------
READABLE = "0123456789.kKmMΩμunpFV AHz-+"
LABEL_ALPHABET = "0123456789.kKmMΩμunpFV AHz-+/"

# ---- fixed values: netlist letters, circuit part types, review enumerations ------------------------
LETTER_TYPES = {"R": "resistor", "C": "capacitor", "L": "inductor", "D": "diode", "V": "voltage_source",
                "I": "current_source", "Q": "transistor", "M": "mosfet", "E": "vcvs", "G": "vccs",
                "H": "ccvs", "F": "cccs", "X": "subcircuit", "S": "switch"}
PART_TYPES = ("resistor", "capacitor", "inductor", "diode", "led", "voltage_source", "current_source",
              "transistor_npn", "transistor_pnp", "mosfet_n", "mosfet_p", "opamp", "switch", "ground",
              "wire")
POLARISED = ("led", "diode", "capacitor")
SAFETY_TYPES = ("short_circuit", "open_circuit", "reverse_polarity", "power_conflict", "overcurrent_risk")
CORRECTNESS_TYPES = ("missing_component", "unnecessary_component", "wrong_topology",
                     "unrealizable_function", "wrong_value")
QUALITY_TYPES = ("parameter_suboptimal", "efficiency", "robustness", "cost", "thermal")

# ---- fixed values: wiring switches, ablation settings and distances ---------------------------------
DEFAULT_SWITCHES = {"use_skeleton": True, "use_degree_constraint": False, "use_nn_filter": True,
                    "use_skel_jj": True, "use_sobel": True, "use_close_port": True,
                    "use_force_connect": True, "use_los": True, "use_ccl": False, "skip_llm": False}
ABLATIONS = {"Ours": {"skip_llm": True},
             "Baseline": {**{k: False for k in DEFAULT_SWITCHES}, "skip_llm": True},
             "w/o_Sobel": {"use_sobel": False, "skip_llm": True},
             "w/_Skeleton": {"use_skeleton": True, "skip_llm": True},
             "CCL": {"use_ccl": True, "skip_llm": True}}
# switches that ask for work on pixels; the vector path can only do without
RASTER_SWITCHES = ("use_skeleton", "use_skel_jj", "use_sobel", "use_ccl")
DIAGONAL = 2000.0
# name: (length at the reference diagonal, floor or None)
SCALED = {"pjr": (300, None), "pjf": (250, None), "jj_align": (15, 8), "jj_max": (1000, None),
          "p2p_max": (100, None), "p2p_line": (200, None), "agg_p2p": (60, None),
          "skel_search": (20, 10), "skel_gap": (12, 8), "grid_snap": (5, 5), "uf_merge": (8, 5)}

# ---- fixed values: selection bins (label, low, high, target) and data set classes --------------------
BINS = (("0-4", 0, 4, 12), ("5-9", 5, 9, 22), ("10-19", 10, 19, 22), ("20+", 20, 999, 14))
CLASSES_V13 = (
    "text", "junction", "crossover", "terminal", "gnd", "vss", "voltage.dc", "voltage.ac", "voltage.battery",
    "resistor", "resistor.adjustable", "resistor.photo", "capacitor.unpolarized", "capacitor.polarized",
    "capacitor.adjustable", "inductor", "inductor.ferrite", "inductor.coupled", "transformer", "diode",
    "diode.light_emitting", "diode.thyrector", "diode.zener", "diac", "triac", "thyristor", "varistor",
    "transistor.bjt", "transistor.fet", "transistor.photo", "operational_amplifier",
    "operational_amplifier.schmitt_trigger", "optocoupler", "integrated_circuit", "integrated_circuit.ne555",
    "integrated_circuit.voltage_regulator", "xor", "and", "or", "not", "nand", "nor", "probe", "probe.current",
    "probe.voltage", "switch", "relay", "socket", "fuse", "speaker", "motor", "lamp", "microphone", "antenna",
    "crystal", "mechanical",
)
CLASSES_V16 = (*CLASSES_V13, "magnetic", "optical", "block", "explanatory", "unknown")

# ---- fixed values: Chinese part names for rendered summaries --------------------------------------
CHINESE = {
    "Resistor": "电阻", "Capacitor": "电容", "Polarized-Capacitor": "极性电容", "Inductor": "电感",
    "Diode": "二极管", "LED": "发光二极管", "Zener Diode": "稳压管", "GND": "地线",
    "V-DC": "直流电压源", "V-AC": "交流电压源", "I-DC": "直流电流源", "I-AC": "交流电流源",
    "BJT-NPN": "NPN三极管", "BJT-PNP": "PNP三极管", "MOSFET-N": "N沟道MOSFET",
    "MOSFET-P": "P沟道MOSFET", "Op-Amp": "运算放大器", "Thyristor": "晶闸管", "Triac": "双向晶闸管",
    "Diac": "双向触发二极管", "Varistor": "压敏电阻", "Lamp": "灯泡", "Potentiometer": "电位器",
    "Photo-Resistor": "光敏电阻", "Transformer": "变压器", "Schmitt-Trigger": "施密特触发器",
    "Optocoupler": "光耦", "IC": "集成电路", "NE555": "NE555定时器", "Voltage-Regulator": "稳压器",
    "Photo-Transistor": "光电三极管", "XOR": "异或门", "AND": "与门", "OR": "或门", "NOT": "非门",
    "NAND": "与非门", "NOR": "或非门", "Switch": "开关", "Relay": "继电器", "Socket": "插座",
    "Fuse": "保险丝", "Speaker": "扬声器", "Motor": "电机", "Microphone": "麦克风", "Antenna": "天线",
    "Crystal": "晶振", "Mechanical": "机械元件", "Magnetic": "磁性元件", "Optical": "光学元件",
    "Block": "模块", "Explanatory": "说明文字", "Unknown": "未知",
}


def mapping(spark: SparkSession, table: dict, key: str, value: str) -> DataFrame:
    """A fixed dictionary as a broadcast two-column DataFrame."""
    return F.broadcast(spark.createDataFrame(list(table.items()), f"{key} string, {value} string"))


def template_rows(profile: str) -> list[tuple]:
    """(name, pi, rx, ry, n_ports, flat): flat when the two default ports lie side by side."""
    rows = []
    for name, pts in TEMPLATES[profile].items():
        flat = len(pts) == 2 and abs(pts[0][0] - pts[1][0]) > abs(pts[0][1] - pts[1][1])
        rows += [(name, i, x, y, len(pts), flat) for i, (x, y) in enumerate(pts)]
    return rows


def templates(spark: SparkSession, profile: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(
        template_rows(profile), "port_key string, pi int, rx double, ry double, n_ports int, flat boolean"))


def label_rows(profile: str) -> list[tuple]:
    return [(n, i, lab) for n, labs in LABELS[profile].items() for i, lab in enumerate(labs)]


def labels(spark: SparkSession, profile: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(label_rows(profile), "name string, pi int, label string"))
