"""Two small synthetic matches in the raw file layout."""

import bz2
import json
import math
import random

PITCHES = {"m1": (105.0, 68.0), "m2": (100.0, 64.0)}
FPS = 5
SECONDS = 90                    # per period


def player_xy(match, side, j, t, period, rng):
    pl, pw = PITCHES[match]
    lines = [0.06] + [0.2] * 4 + [0.45] * 4 + [0.7] * 2
    lanes = [0.5] + [0.15, 0.38, 0.62, 0.85] * 2 + [0.35, 0.65]
    right = (side == "home") == (period == 1)
    x, y = lines[j] * pl * 0.9 + 4 * math.sin(t / 7 + j), lanes[j] * pw + 3 * math.cos(t / 5 + j)
    if j == 0:
        x, y = lines[0] * pl, lanes[0] * pw
    if not right:
        x = pl - x
    jitter = 0 if j == 0 else 0.2
    return x - pl / 2 + rng.uniform(-jitter, jitter), y - pw / 2 + rng.uniform(-jitter, jitter)


def frames_of(match, rng):
    pl, pw = PITCHES[match]
    rows, number = [], 1000
    for period in (1, 2):
        for i in range(SECONDS * FPS):
            t = i / FPS
            row = {"frameNum": number, "period": period, "periodElapsedTime": t, "periodGameClockTime": t + (0 if period == 1 else 2700)}
            for side in ("home", "away"):
                players = []
                for j in range(11):
                    if j == 5 and 100 <= i < 140:
                        continue
                    x, y = player_xy(match, side, j, t, period, rng)
                    players.append({"jerseyNum": str(j + 1), "x": x, "y": y,
                                    "visibility": "VISIBLE" if (i + j) % 9 else "HIDDEN", "confidence": "HIGH"})
                if i % 50 == 49:
                    players.append({"jerseyNum": "", "x": 1.0, "y": 1.0})
                row[f"{side}PlayersSmoothed" if i % 2 else f"{side}Players"] = players
                if i % 2:
                    row[f"{side}Players"] = None
            ball = {"x": pl / 2 * math.sin(t / 11), "y": pw / 2 * math.cos(t / 13), "z": abs(math.sin(t))}
            row["balls"] = [] if i % 37 == 0 else ([ball] if i % 3 else ball)
            rows.append(row)
            number += 1
    return rows


def events_of(match, rows, rng):
    events, eid = [], 1
    kinds = ["PA", "PA", "BC", "PA", "CR", "RE", "PA", "PA", "SH", "CH", "CL"]
    number = {(r["period"], round(r["periodElapsedTime"], 3)): k for k, r in enumerate(rows)}
    for period in (1, 2):
        base = 0 if period == 1 else 2700
        t, seq = 1.0, 1 + (period - 1) * 50
        home = True
        for k in range(70):
            step = rng.choice([0.4, 0.8, 1.2, 2.0])
            t = round(t + step, 3)
            if t > SECONDS - 3:
                break
            if rng.random() < 0.08:
                events.append({"gameEventId": eid, "period": period, "eventTime": base + t, "startGameClock": base + t, "sequence": None,
                               "gameEvents": {"gameEventType": rng.choice(["OUT", "FOUL", "SUB", "G"]), "startTime": base + t, "endTime": base + t,
                                              "homeTeam": home}})
                eid += 1
                continue
            if rng.random() < 0.12:
                seq, home = seq + 1, not home
            kind = rng.choice(kinds)
            ok = rng.random() < 0.85
            rec = {"gameEventId": eid // 2, "possessionEventId": 5000 + eid if k % 4 else None, "period": period, "eventTime": base + t,
                   "startGameClock": base + t, "sequence": seq if k % 11 else str(seq),
                   "gameEvents": {"startTime": base + t - 0.2, "endTime": base + t + 0.6, "homeTeam": home, "setpieceType": "O" if k % 6 else "C",
                                  "videoMissing": k % 17 == 0},
                   "possessionEvents": {"possessionEventType": kind, "passOutcomeType": ("C" if ok else "D") if kind == "PA" else None,
                                        "crossOutcomeType": ("C" if ok else "B") if kind == "CR" else None, "passType": rng.choice(["S", "L"]),
                                        "carryIntent": "D" if kind == "BC" else None, "carrySuccessful": ok if kind == "BC" else None,
                                        "shotOutcomeType": "G" if kind == "SH" and ok else None, "pressureType": rng.choice(["A", "N", None]),
                                        "opportunityType": rng.choice(["C", "D", None])}}
            if k % 13:
                frame = number.get((period, round(round(t * FPS) / FPS, 3)))
                src = rows[frame]
                for side in ("home", "away"):
                    got = src.get(f"{side}PlayersSmoothed") or src.get(f"{side}Players")
                    rec[f"{side}Players"] = [{"playerId": int(p["jerseyNum"]), "positionGroupType": "GK" if p["jerseyNum"] == "1" else "M",
                                              "x": p["x"] * (1 + 0.05 * (k % 5)), "y": p["y"]} for p in got if p["jerseyNum"]]
                if rec["possessionEventId"]:
                    for f in range(frame, min(frame + 2, len(rows))):
                        rows[f]["possessionEventId"] = rec["possessionEventId"]
            events.append(rec)
            eid += 1
    return events


def write_matches(folder):
    rng = random.Random(7)
    for match, (pl, pw) in PITCHES.items():
        d = folder / match
        d.mkdir()
        meta = {"stadium": {"pitches": [{"length": pl, "width": pw}]}, "fps": FPS, "homeTeamStartLeft": True}
        if match == "m2":
            meta = {"pitchLength": pl, "pitchWidth": pw, "fps": FPS, "homeTeamStartLeft": True, "goalkeepers": {"home": {"shirtNumber": 1}}}
        (d / "metadata.json").write_text(json.dumps([meta] if match == "m1" else meta))
        rows = frames_of(match, rng)
        events = events_of(match, rows, rng)
        (d / "events.json").write_text(json.dumps(events if match == "m1" else {"data": events}))
        with bz2.open(d / "tracking.jsonl.bz2", "wt") as f:
            for i, r in enumerate(rows):
                f.write(json.dumps(r) + "\n")
                if i == 10:
                    f.write('{"broken": \n')
    (folder / "incomplete").mkdir()
    (folder / "incomplete" / "metadata.json").write_text("{}")
