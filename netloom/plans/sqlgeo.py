"""SQL text of geometric rules for the oracle."""


def sides(a: str, b: str) -> tuple[str, str]:
    return (f"(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))", f"(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1))")


def overlaps(a: str, b: str) -> str:
    w, h = sides(a, b)
    return f"({w}>0 AND {h}>0)"


def inter(a: str, b: str) -> str:
    w, h = sides(a, b)
    return f"(CASE WHEN {w}>0 AND {h}>0 THEN {w}*{h} ELSE 0 END)"


def area(a: str) -> str:
    return f"(({a}.x2-{a}.x1)*({a}.y2-{a}.y1))"


def iou(a: str, b: str) -> str:
    i = inter(a, b)
    return f"(CAST({i} AS DOUBLE)/({area(a)}+{area(b)}-{i}))"


def dist(x1, y1, x2, y2) -> str:
    return f"sqrt(CAST((({x1})-({x2}))*(({x1})-({x2}))+(({y1})-({y2}))*(({y1})-({y2})) AS DOUBLE))"


def manhattan(x1, y1, x2, y2) -> str:
    return f"(abs(({x1})-({x2}))+abs(({y1})-({y2})))"


def _turn(a, b, c):
    return f"(({b[0]}-{a[0]})*({c[1]}-{a[1]})-({b[1]}-{a[1]})*({c[0]}-{a[0]}))"


def _within(p, a, b):
    return (f"({p[0]} BETWEEN least({a[0]},{b[0]}) AND greatest({a[0]},{b[0]}) AND "
            f"{p[1]} BETWEEN least({a[1]},{b[1]}) AND greatest({a[1]},{b[1]}))")


def segments_meet(a, b, c, d) -> str:
    d1, d2, d3, d4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    return (f"((sign({d1})*sign({d2})<0 AND sign({d3})*sign({d4})<0) OR ({d1}=0 AND {_within(c, a, b)}) OR "
            f"({d2}=0 AND {_within(d, a, b)}) OR ({d3}=0 AND {_within(a, c, d)}) OR ({d4}=0 AND {_within(b, c, d)}))")


def segment_meets_box(a, b, r) -> str:
    x1, y1, x2, y2 = r
    quick = (f"greatest({a[0]},{b[0]})>={x1} AND least({a[0]},{b[0]})<={x2} AND "
             f"greatest({a[1]},{b[1]})>={y1} AND least({a[1]},{b[1]})<={y2}")
    ins = " OR ".join(f"({p[0]} BETWEEN {x1} AND {x2} AND {p[1]} BETWEEN {y1} AND {y2})" for p in (a, b))
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    cuts = " OR ".join(segments_meet(a, b, corners[i], corners[(i + 1) % 4]) for i in range(4))
    return f"({quick} AND ({ins} OR {cuts}))"


def crosses(a, b, own: str, comps: str, image: str) -> str:
    """EXISTS: the segment meets the grown box of another component of the picture."""
    box = ("(z.x1-8)", "(z.y1-8)", "(z.x2+8)", "(z.y2+8)")
    return (f"EXISTS (SELECT 1 FROM {comps} z WHERE z.image_id={image} AND z.idx<>{own} AND "
            f"{segment_meets_box(a, b, box)})")
