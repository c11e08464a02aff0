"""Made-up recordings from a seed, and one writer for each dialect of session files."""

import json
import random

PARTS = ["snout", "rump"]
ZONES = ["north", "south", "nest"]


def recording(seed=1, frames=5):
    """A canonical table of frames (None: absent), and what the header says. The third frame's clock can't be read."""
    rng = random.Random(seed)
    step, start = rng.randint(21, 49), rng.randint(10**9, 10**12)
    out = []
    for i in range(frames):
        seen = i == 0 or rng.random() < 0.5
        out.append(
            {
                "number": i,
                "ms": None if i == 2 else float(i * step),
                "host": start + i * step * 10**6 + rng.randint(0, 999),
                "fw": None if i == 1 else float(rng.randint(1, 10**5)),
                "speed": None if i == 1 else rng.randint(1, 99) / 4,
                "zone": None if i == 1 else rng.choice(ZONES),
                "states": [] if i == 1 else rng.sample(["rest", "walk", "turn"], 2 if i == 2 else 1),
                "pose": [(rng.randint(0, 800) / 8, rng.randint(0, 800) / 8, rng.randint(1, 9) / 10) for _ in PARTS] if seen and i != 1 else None,
                "off": i == 1,
                "more": f"extra{rng.randint(10, 99)}",
            }
        )
    corner = lambda: [rng.randint(1, 40) * 2, rng.randint(1, 40) * 2]
    head = {"subject": f"mouse-{rng.randint(100, 999)}", "started": f"2031-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} 08:30:00.000", "fps": rng.randint(12, 90), "crop": [rng.randint(1, 9) * 11 for _ in range(4)], "zone": rng.choice(ZONES), "corners": [corner(), corner(), corner()]}
    return out, head


def clock(ms):
    return "unreadable" if ms is None else f"{int(ms // 60000):02d}:{int(ms // 1000 % 60):02d}.{int(ms % 1000):03d}"


def plain_ms(f):
    return "unreadable" if f["ms"] is None else f"{f['ms']:g}"


def cell(v):
    return "na" if v is None else f"{v:g}" if isinstance(v, float) else str(v)


def states(f):
    return "|".join(f["states"]) or "-"


def listed(f):
    return "na" if f["off"] else "none" if f["pose"] is None else json.dumps([list(p) for p in f["pose"]])


def named(f):
    return "na" if f["off"] else "none" if f["pose"] is None else json.dumps(dict(zip(PARTS, map(list, f["pose"]))))


def hash_file(frames, head):
    zones = {"scale": {}, "zones": {head["zone"]: {"type": "polygon", "points": [[x / 100, y / 100] for x, y in head["corners"]], "coord_space": "normalized"}}}
    lines = ["#version   3", f"#session_start     {head['started']}", '#units {"px_per_cm": 7}', "# a remark", "#zone_config_begin", *json.dumps(zones, indent=1).split("\n"), "#zone_config_end"]
    lines += ["#columns frame elapsed capture_host_ns frame_fw_ms pose zone state more speed", f"#body_parts {json.dumps(PARTS)}"]
    lines += ["\t".join((str(f["number"]), clock(f["ms"]), str(f["host"]), cell(f["fw"]), listed(f), cell(f["zone"]), states(f), f["more"], "none" if f["speed"] is None else cell(f["speed"]))) for f in frames]
    return "\n".join(lines) + "\n"


def column_file(frames, head, told=((0.02, "print", "task", "hello"),)):
    zones = [{"name": head["zone"], "type": "rectangle", "enabled": True, "points": head["corners"]}, {"name": "bare"}]
    lines = ["time\ttype\tsubtype\tcontent", f"0.000\tinfo\tsubject_id\t{head['subject']}", f"0.000\tinfo\tbody_parts\t{json.dumps(PARTS)}", f"Zones\t{json.dumps(zones)}", "# frame_number\tcam\tactual_ts\tspeed\tlocation\tpose_array\tstage"]
    rows = ["\t".join((str(f["number"]), f["more"], plain_ms(f), "none" if f["speed"] is None else cell(f["speed"]), "none" if f["zone"] is None else f["zone"], named(f), states(f))) for f in frames]
    return "\n".join([*lines, rows[0], *(f"{t:.3f}\t" + "\t".join(rest) for t, *rest in told), *rows[1:]]) + "\n"


def plain_file(frames):
    return "\n".join("\t".join((str(f["number"]), plain_ms(f), "na", cell(f["fw"]), cell(f["speed"]), "none" if f["zone"] is None else f["zone"], named(f), states(f))) for f in frames) + "\n"


def object_file(frames, head, again=1):
    """With as many of the first frames once more at the end, so that the counter falls."""
    lines = ["B " + json.dumps({"Subject ID": head["subject"], "fps": head["fps"], "list": [4, 5]}), "", "M " + json.dumps({"zones": {head["zone"]: {"name": head["zone"], "type": "polygon", "values": head["corners"], "points": None}}, "arena": {"w": 3}}), "", "V " + json.dumps(head["crop"]), ""]
    for f in [*frames, *frames[:again]]:
        ms = "unreadable" if f["ms"] is None else f["ms"]
        lines.append(json.dumps({"frames": f["number"], "mcu_frame": 0, "state_name": "|".join(f["states"]) or None, "timestamps": ms, "speed": f["speed"], "location": f["zone"], "pose_array": f["pose"]}))
    return "\n".join(lines) + "\n"
