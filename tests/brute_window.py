"""The windowed stream's rules on plain dictionaries, one group of arrivals at a time."""

import math

import numpy as np

from tests.brute import ratio


class Window:
    def __init__(self, k, window, inlier_percent, max_age, dims, top, step):
        self.k, self.size, self.percent, self.max_age = k, window, inlier_percent, max_age
        self.dims, self.top_n, self.step = dims, top, step
        self.points, self.areas, self.top, self.labels, self.clock = {}, {}, [], {}, 0

    def cut(self, near):
        ranked = sorted(near.items(), key=lambda e: (e[1], e[0]))
        kd = ranked[min(self.k, len(ranked)) - 1][1] if ranked else math.inf
        return {j: d for j, d in ranked if d <= kd}, kd

    def rim(self, x):
        for c, area in self.areas.items():
            d = math.dist(x, area["x"])
            for axis in range(self.dims):
                for side in range(2):
                    j = -1 - (c * 2 * self.dims + axis * 2 + side)
                    off = math.sqrt(d * d + area["radius"] ** 2)
                    yield j, off if axis else (d - area["radius"] if side == 0 else d + area["radius"])

    def profile(self, j):
        if j >= 0:
            return self.points[j]["kd"], self.points[j]["lrd"]
        area = self.areas[(-1 - j) // (2 * self.dims)]
        return area["avg_kd"], area["avg_lrd"]

    def delete(self, gone):
        for i in gone:
            self.points.pop(i, None)
        for p in self.points.values():
            p["near"] = {j: d for j, d in p["near"].items() if j not in gone}

    def run(self, points):
        """All of ``points``, group by group; the state after each group, and the label and reason
        of every point."""
        taken, owner, history = 0, {}, []
        while taken < len(points):
            room = self.size - len(self.points)
            group = range(taken, min(len(points), taken + (min(room, self.step) if room > 0 else self.step)))
            known = {tuple(p["x"]): i for i, p in self.points.items()}
            for i in group:
                owner[i] = known.setdefault(tuple(points[i]), i)
            self.apply([(i, points[i]) for i in group if owner[i] == i])
            taken = group[-1] + 1
            history.append((
                {i: (set(p["near"]), p["ts"], p["kd"], p["lrd"], p["lof"]) for i, p in self.points.items()},
                {c: (a["number"], a["ts"], a["radius"], a["avg_kd"], a["avg_lrd"]) for c, a in self.areas.items()},
            ))
        labels = self.final()
        return history, {i: labels[owner[i]] for i in owner}

    def apply(self, batch):
        fresh = {i: x for i, x in batch if tuple(x) not in {tuple(p["x"]) for p in self.points.values()}}
        inside = [
            (c, i, math.dist(x, a["x"])) for c, a in self.areas.items() for i, x in fresh.items()
            if math.dist(x, a["x"]) <= a["radius"]
        ]
        touched, moved = set(fresh), set(fresh)
        lists = {}
        for i, x in fresh.items():
            near = {j: math.dist(x, p["x"]) for j, p in self.points.items()}
            near |= {j: math.dist(x, y) for j, y in fresh.items() if j != i}
            lists[i] = self.cut(near | dict(self.rim(x)))
        for i, p in self.points.items():
            hits = {j: math.dist(p["x"], x) for j, x in fresh.items()}
            hits = {j: d for j, d in hits.items() if d <= p["kd"] or len(p["near"]) < self.k}
            if hits:
                touched.add(i)
                was = p["kd"]
                p["near"], p["kd"] = self.cut(p["near"] | hits)
                if p["kd"] != was:
                    moved.add(i)
        for i, x in fresh.items():
            self.points[i] = {"x": x, "near": lists[i][0], "kd": lists[i][1], "ts": None}
        dense = touched | {i for i, p in self.points.items() if moved & set(p["near"])}
        for i in dense:
            p = self.points[i]
            reach = sum(max(self.profile(j)[0] if j < 0 else self.points[j]["kd"], d) for j, d in p["near"].items())
            p["lrd"] = ratio(len(p["near"]), reach) if p["near"] else math.inf
        for i, p in self.points.items():
            if i in dense or dense & set(p["near"]):
                around = sum(self.profile(j)[1] for j in p["near"])
                p["lof"] = ratio(around, p["lrd"] * len(p["near"])) if p["near"] else math.nan

        absorbed = {i for _, i, _ in inside}
        for i in sorted(set(fresh) - absorbed):
            self.points[i]["ts"], self.clock = self.clock, self.clock + 1
        for c in {c for c, _, _ in inside}:
            area, mine = self.areas[c], [(i, d) for c2, i, d in inside if c2 == c]
            number = area["number"] + len(mine)
            for avg, part in (("avg_kd", "kd"), ("avg_lrd", "lrd")):
                area[avg] = (area[avg] * area["number"] + sum(self.points[i][part] for i, _ in mine)) / number
            area.update(number=number, radius=min(d for _, d in mine), ts=self.clock)
        self.delete(absorbed)
        self.labels |= {i: (0, "absorbed") for i in absorbed}

        if len(self.points) + self.step > self.size:
            self.summarize()
        if len(self.points) + self.step > self.size:
            self.age_out()

    def summarize(self):
        order = sorted(self.points, key=lambda i: (math.isnan(self.points[i]["lof"]), round(self.points[i]["lof"], 9), i))
        doomed, made = set(), {}
        for c in order[: math.ceil(len(order) * self.percent / 100.0)]:
            p = self.points[c]
            kds, lrds = zip(*(self.profile(j) for j in p["near"])) if p["near"] else ((), ())
            made[c] = {
                "x": p["x"], "radius": p["kd"], "number": len(kds) + 1, "ts": self.clock,
                "avg_kd": ratio(sum(kds), len(kds)), "avg_lrd": ratio(sum(lrds), len(lrds)),
            }
            doomed |= {c, *p["near"]}
        self.labels |= {i: (0, "summarized") for i in doomed if i >= 0}
        self.delete(doomed)
        self.areas |= made

    def age_out(self):
        aged = {i for i, p in self.points.items() if self.clock - p["ts"] > self.max_age}
        self.top = self.best([*self.top, *((i, self.points[i]["lof"]) for i in aged)])
        self.labels |= {i: (int(i in {t for t, _ in self.top}), "aged") for i in aged}
        self.delete(aged)
        expired = {c for c, a in self.areas.items() if self.clock - a["ts"] > self.max_age}
        stale = {j for p in self.points.values() for j in p["near"] if j < 0 and (-1 - j) // (2 * self.dims) in expired}
        self.delete(stale)
        for c in expired:
            del self.areas[c]

    def best(self, rows):
        return sorted(rows, key=lambda t: (not math.isnan(t[1]), -round(np.nan_to_num(t[1], nan=0.0), 9), t[0]))[: self.top_n]

    def final(self):
        top = {i for i, _ in self.best([*self.top, *((i, p["lof"]) for i, p in self.points.items())])}
        return self.labels | {i: (int(i in top), "final") for i in self.points}
