"""DuckDB SQL of the raster queries: the same numbers, written from the definitions."""

from __future__ import annotations

from rasterloom.raster_queries import _DESCRIPTORS, BIAS, CW, DIRECTION, LEVELS, MEAN, W

_EVENTS = """ev AS (
  SELECT 0 AS plane, (event_id % 100)::int AS x, (event_id // 100)::int AS y,
    least(255, floor(value))::int / 255.0::double AS c0, (hour(ts) * 11)::int / 255.0::double AS c1, ((user_id * 37) % 256)::int / 255.0::double AS c2
  FROM events),
dims AS (SELECT 100 AS w, ((SELECT count(*) FROM events) // 100)::int AS h)"""

_ORDERS = """od AS (
  SELECT 0 AS plane, (o_orderkey % 100)::int AS x, (o_orderkey // 100)::int AS y,
    floor(o_totalprice / 2000)::int / 255.0::double AS c0, (dayofyear(o_orderdate) % 256)::int / 255.0::double AS c1, (substr(o_orderpriority, 1, 1)::int * 51) / 255.0::double AS c2
  FROM orders)"""

# Both textures on the higher one's extent, holes as 0.
_BOTH = f"""{_EVENTS},
{_ORDERS},
grid AS (SELECT 0 AS plane, (id % 100)::int AS x, (id // 100)::int AS y FROM (SELECT unnest(range(100 * greatest((SELECT h FROM dims), ((SELECT count(*) FROM orders) + 99) // 100))) AS id)),
evf AS (SELECT g.plane, g.x, g.y, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2 FROM grid g LEFT JOIN ev USING (x, y)),
odf AS (SELECT g.plane, g.x, g.y, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2 FROM grid g LEFT JOIN od USING (x, y))"""


def _byte(c: str) -> str:
    return f"floor(round(least(1.0::double, greatest(0.0::double, {c})) * 255, 9) + 0.5)::int"


def _geometry(levels: int | None) -> str:
    more = f"plane < {levels}" if levels is not None else "plane < 12 AND w0 // 2 >= 8 AND h0 // 2 >= 8"
    return f"""size(plane, w0, h0, w1, h1) AS (
  SELECT 0, w, h, w // 4, h // 4 FROM dims
  UNION ALL
  SELECT plane + 1, greatest(1, w0 // 2), greatest(1, h0 // 2), greatest(1, w1 // 2), greatest(1, h1 // 2) FROM size WHERE {more})"""


def _box(name: str, above: str, m: int, digits: bool = False) -> str:
    """Level m by halving level m - 1; its extent is in ``size``."""
    return f"""{name} AS (
  SELECT {m} AS plane, (x // 2)::int AS x, (y // 2)::int AS y, avg(c0) AS c0, avg(c1) AS c1, avg(c2) AS c2
  FROM {above}, (SELECT w0 AS pw, h0 AS ph FROM size WHERE plane = {m - 1})
  WHERE x < greatest(1, pw // 2) * 2 AND y < greatest(1, ph // 2) * 2 GROUP BY x // 2, y // 2)"""


def _chain(levels: int) -> str:
    """src: the source chain of the events raster."""
    parts, above = [], "ev"
    for m in range(1, levels + 1):
        parts.append(_box(f"m{m}", above, m))
        above = f"m{m}"
    union = " UNION ALL ".join(["SELECT plane, x, y, c0, c1, c2 FROM ev", *[f"SELECT plane, x, y, c0, c1, c2 FROM m{m}" for m in range(1, levels + 1)]])
    return ",\n".join([*parts, f"src AS ({union})"])


_MEANS = """means AS (
  SELECT s.plane, least(((x + 1)::bigint * w1 - 1) // w0, w1 - 1)::int AS x, least(((y + 1)::bigint * h1 - 1) // h0, h1 - 1)::int AS y, avg(c0) AS c0, avg(c1) AS c1, avg(c2) AS c2
  FROM src s JOIN size USING (plane) GROUP BY ALL),
l1 AS (SELECT plane, x, y, 2 * c0 - 1 AS v0, 2 * c1 - 1 AS v1 FROM means),
l0 AS (SELECT plane, x, y, 2 * (0.299::double * c0 + 0.587::double * c1 + 0.114::double * c2) - 1 AS s0 FROM src)"""


def _head(levels: int = 0, more: str = "", base: str = _EVENTS) -> str:
    return f"WITH RECURSIVE {base},\n{_geometry(levels)},\n{_chain(levels)},\n{_MEANS}{more}"


def _gather(name: str, points: str, plane: str, columns: dict[str, str], px: str, py: str, w: str, h: str, keep: str) -> str:
    """CTE ``name``: ``points`` with a plane read bilinearly at (px, py); ``columns``: output to plane column."""
    sums = ", ".join(f"sum(wt * t.{c}) AS {o}" for o, c in columns.items())
    kept = ", ".join(f"q.{c.strip()} AS {c.strip()}" for c in keep.split(","))
    return f"""{name} AS (
  SELECT {kept}, {sums}
  FROM (
    SELECT {keep}, plane AS tp, least(greatest(floor(px)::int + a, 0), {w} - 1) AS tx, least(greatest(floor(py)::int + b, 0), {h} - 1) AS ty,
      (CASE a WHEN 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END) * (CASE b WHEN 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END) AS wt
    FROM (SELECT p.*, size.* EXCLUDE (plane), {px} AS px, {py} AS py FROM {points} p JOIN size USING (plane)), (VALUES (0), (1)) ax(a), (VALUES (0), (1)) ay(b)
  ) q JOIN {plane} t ON t.plane = tp AND t.x = tx AND t.y = ty
  GROUP BY {", ".join(f"q.{c.strip()}" for c in keep.split(","))})"""


def _scaled(p: str, d: str, n0: str, n: str) -> str:
    return f"CASE WHEN {n} = {n0} THEN ({p} + {d})::double ELSE ({p} + 0.5::double + {d}) * {n} / {n0} - 0.5::double END"


_Z = {"z0": "v0", "z1": "v1"}


def _level1(points: str, keep: str = "plane, x, y", dx: str = "0", dy: str = "0", name: str = "z", plane: str = "l1") -> str:
    return _gather(name, points, plane, _Z, _scaled("x", dx, "w0", "w1"), _scaled("y", dy, "h0", "h1"), "w1", "h1", keep)


_OFFSETS = "(VALUES (0, 0.0::double, 0.0::double), (1, -0.375::double, -0.125::double), (2, -0.125::double, 0.375::double), (3, 0.125::double, -0.375::double), (4, 0.375::double, 0.125::double)) o(j, ox, oy)"
_TURNED_X = "CASE (y % 2) * 2 + x % 2 WHEN 0 THEN ox WHEN 1 THEN -oy WHEN 2 THEN -ox ELSE oy END"
_TURNED_Y = "CASE (y % 2) * 2 + x % 2 WHEN 0 THEN oy WHEN 1 THEN ox WHEN 2 THEN -oy ELSE -ox END"


def _sites(l0: str = "l0", src: str = "src", l1: str = "l1") -> str:
    """rows: every site (K = 4) with s0, t0 to t2, z0, z1."""
    keep = "plane, x, y, j, dx, dy"
    both = f"both_ AS (SELECT s.plane, s.x, s.y, s0, c0, c1, c2 FROM {l0} s JOIN {src} USING (plane, x, y)),\n"
    points = f"points AS (SELECT plane, x, y, j, {_TURNED_X} AS dx, {_TURNED_Y} AS dy FROM {src}, {_OFFSETS}),\n"
    full = _gather("full_", "points", "both_", {"s0": "s0", "t0": "c0", "t1": "c1", "t2": "c2"}, "x + dx", "y + dy", "w0", "h0", keep)
    return both + points + full + ",\n" + _level1("points", keep, "dx", "dy", plane=l1) + ",\nrows_ AS (SELECT * FROM full_ JOIN z USING (plane, x, y, j, dx, dy))"


def _outputs(s: str = "s0", z: tuple[str, str] = ("z0", "z1"), terms: int = 5) -> list[str]:
    out = []
    for row, b in zip(W, BIAS, strict=True):
        phi = [z[0], z[1], s, f"{s} * {z[0]}", f"{s} * {z[1]}"][:terms]
        out.append(f"({b!r}::double + " + " + ".join(f"{w!r}::double * {p}" for w, p in zip(row[:terms], phi, strict=True)) + ")")
    return out


def _error() -> str:
    return " + ".join(f"({o} - t{i}) * ({o} - t{i})" for i, o in enumerate(_outputs()))


def _weighted() -> str:
    return " + ".join(f"{c!r}::double * ({o} - t{i}) * ({o} - t{i})" for i, (c, o) in enumerate(zip(CW, _outputs(), strict=True)))


def _decoded(levels: int) -> str:
    """out: the decoded planes, clamped."""
    columns = ", ".join(f"least(1.0::double, greatest(0.0::double, {o})) AS c{i}" for i, o in enumerate(_outputs()))
    return _head(levels, ",\n" + _level1("l0", "plane, x, y, s0") + f",\nout AS (SELECT plane, x, y, {columns} FROM z)")


def _by_gradients(name: str, plane: str, columns: dict[str, str], w: str, h: str, scale: float, mode: str) -> str:
    """CTE ``name``: pts (id, u, v and gradients) with a plane's values where, and of the level that, their gradients say."""
    most = 8 if mode == "anisotropic" else 1
    level = "CASE WHEN long_ > 0 THEN log2(long_ / n) ELSE 0 END"
    level = f"floor({level} + 0.5::double)" if mode in ("point", "bilinear") else level
    means = ", ".join(f"sum(f * {o}) / any_value(n) AS {o}" for o in columns)
    kept = "id, i, n, plane, f"
    if mode == "point":
        values = ", ".join(f"t.{c} AS {o}" for o, c in columns.items())
        at = lambda p, n: f"greatest(0, least(floor({p} * {n})::int, {n} - 1))"
        read = f"{name}_r AS (SELECT p.id, p.i, p.n, p.plane, p.f, {values} FROM {name}_two p JOIN size USING (plane) JOIN {plane} t ON t.plane = p.plane AND t.x = {at('u', w)} AND t.y = {at('v', h)} WHERE f > 0)"
    else:
        read = _gather(f"{name}_r", f"{name}_two", plane, columns, f"u * {w} - 0.5::double", f"v * {h} - 0.5::double", w, h, kept)
    return f"""{name}_g AS (SELECT id, u, v, dudx * {scale!r}::double AS ax, dvdx * {scale!r}::double AS ay, dudy * {scale!r}::double AS bx, dvdy * {scale!r}::double AS b_y, {w}::double AS w_, {h}::double AS h_ FROM pts, (SELECT {w}, {h} FROM size WHERE plane = 0)),
{name}_l AS (SELECT *, sqrt(ax * w_ * (ax * w_) + ay * h_ * (ay * h_)) AS across, sqrt(bx * w_ * (bx * w_) + b_y * h_ * (b_y * h_)) AS down FROM {name}_g),
{name}_s AS (SELECT *, greatest(across, down) AS long_, least(across, down) AS short_ FROM {name}_l),
{name}_n AS (SELECT *, least({most}, CASE WHEN long_ <= short_ THEN 1 WHEN short_ = 0 THEN {most} ELSE ceil(long_ / short_) END)::double AS n FROM {name}_s),
{name}_p AS (SELECT id, i, n, u + CASE WHEN across >= down THEN ax ELSE bx END * (i / (n + 1) - 0.5::double) AS pu, v + CASE WHEN across >= down THEN ay ELSE b_y END * (i / (n + 1) - 0.5::double) AS pv, u, v, greatest(0, least({level}, {LEVELS}))::double AS lod FROM {name}_n, (SELECT unnest(range(1, {most + 1}))::double AS i) WHERE i <= n),
{name}_q AS (SELECT id, i, n, {'pu' if most > 1 else 'u'} AS u, {'pv' if most > 1 else 'v'} AS v, lod FROM {name}_p),
{name}_two AS (SELECT id, i, n, u, v, floor(lod)::int AS plane, 1 - (lod - floor(lod)) AS f FROM {name}_q UNION ALL SELECT id, i, n, u, v, least(floor(lod)::int + 1, {LEVELS}), lod - floor(lod) FROM {name}_q),
{read},
{name} AS (SELECT id, {means} FROM {name}_r GROUP BY id)"""


def _gradient_sampling(modes: tuple[tuple[str, float, int], ...], named: bool) -> str:
    """Points by their gradients, decoded: (mode, scale of level 1's gradients, columns of the decoder)."""
    pts = "pts AS (SELECT id, (id * 37 % 1000)::double / 1000 AS u, (id * 91 % 997)::double / 997 AS v, (id % 7)::double / 200 AS dudx, (id % 3)::double / 500 AS dvdx, (id % 5)::double / 400 AS dudy, (id % 11)::double / 300 AS dvdy FROM (SELECT unnest(range(2000)) AS id))"
    parts, out = [], []
    for mode, scale, terms in modes:
        parts += [_by_gradients(f"{mode}_0", "l0", {"s0": "s0"}, "w0", "h0", 1.0, mode), _by_gradients(f"{mode}_1", "l1", _Z, "w1", "h1", scale, mode)]
        values = ", ".join(f"round(least(1.0::double, greatest(0.0::double, {o})), 9) AS c{i}" for i, o in enumerate(_outputs(terms=terms)))
        out.append(f"SELECT {f"'{mode}' AS mode, " if named else ''}id, {values} FROM {mode}_0 JOIN {mode}_1 USING (id)")
    return f"{_head(LEVELS)},\n{pts},\n" + ",\n".join(parts) + "\n" + " UNION ALL ".join(out)


def _kernel(kernel: str, x: str) -> str:
    b, c = (1 / 3, 1 / 3) if kernel == "mitchell" else (0.0, 0.5)
    near = f"(({12 - 9 * b - 6 * c!r}::double * {x} + {-18 + 12 * b + 6 * c!r}::double) * {x} * {x} + {6 - 2 * b!r}::double) / 6"
    far = f"((({-b - 6 * c!r}::double * {x} + {6 * b + 30 * c!r}::double) * {x} + {-12 * b - 48 * c!r}::double) * {x} + {8 * b + 24 * c!r}::double) / 6"
    return f"CASE WHEN {x} < 1 THEN {near} WHEN {x} < 2 THEN {far} ELSE 0 END"


def _resize(kernel: str, edge: str) -> str:
    def axis(name: str, n: str) -> str:
        at = f"((j % {n}) + {n}) % {n}" if edge == "wrap" else f"least({n} - 1, greatest(0, j))"
        out = f"greatest(1, {n} // 2)"
        return f"""{name}_raw AS (
  SELECT i, {at} AS j, {_kernel(kernel, 'd')} AS wt FROM (
    SELECT i, j, abs((j + 0.5::double - (i + 0.5::double) / ({out}::double / {n})) * ({out}::double / {n})) AS d, w, h
    FROM (SELECT i, (floor((i + 0.5::double) / ({out}::double / {n}))::int + k)::int AS j, w, h FROM (SELECT unnest(range({out}))::int AS i, w, h FROM dims), (SELECT unnest(range(-8, 9))::int AS k)))),
{name} AS (SELECT i, j, sum(wt) / (SELECT sum(wt) FROM {name}_raw r WHERE r.i = q.i) AS wt FROM {name}_raw q GROUP BY i, j)"""

    return f"""WITH {_EVENTS},
{axis('ax', 'w')},
{axis('ay', 'h')},
across AS (SELECT plane, i AS x, y, sum(c0 * wt) AS c0, sum(c1 * wt) AS c1, sum(c2 * wt) AS c2 FROM ev JOIN ax ON ev.x = ax.j GROUP BY plane, i, y)
SELECT plane, x::int AS x, i::int AS y, round(sum(c0 * wt), 6) AS c0, round(sum(c1 * wt), 6) AS c1, round(sum(c2 * wt), 6) AS c2
FROM across JOIN ay ON across.y = ay.j GROUP BY plane, x, i"""


def _replicate(k: str, bits: int) -> str:
    parts, shift = [], 8 - bits
    while shift > -bits:
        parts.append(f"({k} << {shift})" if shift >= 0 else f"({k} >> {-shift})")
        shift -= bits
    return "((" + " | ".join(parts) + ") & 255)"


def _grid_value(bits: int, k: str) -> str:
    return f"(-1.0::double + {_replicate(k, bits)}::double / 255 * 2)::float::double"


def _grid_index(bits: int, v: str) -> str:
    n = (1 << bits) - 1
    return f"(SELECT arg_min(k, (abs({v} - {_grid_value(bits, 'k')}), k)) FROM (SELECT unnest(range(0, {n + 1}))::int AS k))"


_INDEXED = "ix AS (SELECT plane, x, y, unnest([0, 1, 2])::int AS ch, unnest([{0}, {1}, {2}]) >> {{shift}} AS v FROM ev)".format(*[_byte(f"c{i}") for i in range(3)])


def _blocks(bits: int) -> str:
    """texels (edge repeated) of 4-bit blocks with their nearest selectors."""
    return f"""WITH {_EVENTS}, {_INDEXED.format(shift=8 - bits)},
full_ AS (
  SELECT ch, px // 4 AS bx, py // 4 AS yb, (py % 4) * 4 + px % 4 AS t, px, py, v, w, h
  FROM (SELECT ch, px, py, least(px, w - 1) AS sx, least(py, h - 1) AS sy, w, h FROM dims, (SELECT unnest(range(((SELECT w FROM dims) + 3) // 4 * 4))::int AS px), (SELECT unnest(range(((SELECT h FROM dims) + 3) // 4 * 4))::int AS py), (SELECT unnest([0, 1, 2])::int AS ch))
  JOIN ix USING (ch) WHERE ix.x = sx AND ix.y = sy),
ends AS (SELECT ch, bx, yb, floor(max(v) * 255.0::double / 15 + 0.5)::int AS r0, floor(min(v) * 255.0::double / 15 + 0.5)::int AS r1 FROM full_ GROUP BY ALL),
pal AS (
  SELECT ch, bx, yb, r0, r1, s, CASE WHEN s = 0 THEN r0 WHEN s = 1 THEN r1 WHEN r0 > r1 THEN (((8 - s) * r0 + (s - 1) * r1)::double / 7)::float::double
    WHEN s = 6 THEN 0 WHEN s = 7 THEN 255 ELSE (((6 - s) * r0 + (s - 1) * r1)::double / 5)::float::double END AS p
  FROM ends, (SELECT unnest(range(8))::int AS s)),
near AS (
  SELECT f.ch, f.bx, f.yb, t, px, py, w, h, v, r0, r1, CASE WHEN r0 = r1 THEN 0 ELSE arg_min(s, ((abs(p - (v * 255.0::double / 15)::float::double))::float, s)) END AS sel,
    arg_min(p, (CASE WHEN r0 = r1 THEN s::float ELSE (abs(p - (v * 255.0::double / 15)::float::double))::float END, s)) AS value
  FROM full_ f JOIN pal USING (ch, bx, yb) GROUP BY f.ch, f.bx, f.yb, t, px, py, w, h, v, r0, r1)"""


def _on_grid(name: str, plane: str, column: str) -> str:
    """CTE ``name``: plane, x, y and the 8-bit index ``k`` of a column, looked up once per distinct value."""
    return f"{name}_u AS (SELECT DISTINCT round({column}, 9) AS v FROM {plane}), {name}_k AS (SELECT v, {_grid_index(8, 'v')}::int AS k FROM {name}_u), {name} AS (SELECT plane, x, y, k FROM {plane} p JOIN {name}_k ON round(p.{column}, 9) = v)"


def _stored() -> str:
    """l1q: level 1 as its bytes give it back."""
    return f"{_on_grid('ka', 'l1', 'v0')}, {_on_grid('kb', 'l1', 'v1')}, l1q AS (SELECT plane, x, y, {_grid_value(8, 'ka.k')} AS v0, {_grid_value(8, 'kb.k')} AS v1 FROM ka JOIN kb USING (plane, x, y))"


def _asset() -> str:
    """out: the chain decoded from level 0 in blocks and level 1 in bytes."""
    columns = ", ".join(f"least(1.0::double, greatest(0.0::double, {o})) AS c{i}" for i, o in enumerate(_outputs()))
    more = f""",
{_on_grid('kl', 'l0', 's0')},
{_stored()},
ends AS (SELECT plane, x // 4 AS bx, y // 4 AS yb, max(k) AS r0, min(k) AS r1 FROM kl GROUP BY ALL),
pal AS (
  SELECT plane, bx, yb, r0, r1, s, CASE WHEN s = 0 THEN r0 WHEN s = 1 THEN r1 WHEN r0 > r1 THEN (((8 - s) * r0 + (s - 1) * r1)::double / 7)::float::double
    WHEN s = 6 THEN 0 WHEN s = 7 THEN 255 ELSE (((6 - s) * r0 + (s - 1) * r1)::double / 5)::float::double END AS p
  FROM ends, (SELECT unnest(range(8))::int AS s)),
near AS (SELECT kl.plane, kl.x, kl.y, arg_min(p, (CASE WHEN r0 = r1 THEN s::float ELSE abs(p - k)::float END, s)) AS b FROM kl JOIN pal ON kl.plane = pal.plane AND kl.x // 4 = bx AND kl.y // 4 = yb GROUP BY ALL),
l0q AS (SELECT plane, x, y, (-1.0::double + b::double / 255 * 2)::float::double AS s0 FROM near),
{_gather('z', 'l0q', 'l1q', _Z, _scaled('x', '0', 'w0', 'w1'), _scaled('y', '0', 'h0', 'h1'), 'w1', 'h1', 'plane, x, y, s0')},
out AS (SELECT plane, x, y, {columns} FROM z)"""
    return _head(LEVELS, more)


def _relabel(bits: int) -> str:
    """Lossless at one to three bits: error 0 for every texel of the plane."""
    return f"SELECT ch, 0.0::double AS se, count(*)::bigint AS n, {bits} AS bits FROM ev, (SELECT unnest([0, 1, 2])::int AS ch) GROUP BY ch"


def _psnr_of(mse: str) -> str:
    return f"CASE WHEN {mse} > 0 THEN 10 * log10(65025.0::double / ({mse})) ELSE 100 END"


def _errors(a: str, b: str) -> str:
    return f"""err AS (
  SELECT a.plane, a.x, a.y, unnest([0, 1, 2])::int AS ch, unnest([{', '.join(f"{_byte(f'a.c{i}')} - {_byte(f'b.c{i}')}" for i in range(3))}]) AS d
  FROM {a} a JOIN {b} b ON a.plane = b.plane AND a.x = b.x AND a.y = b.y)"""


def _rank(q: float, value: str, upto: str = "upto", all_: str = "total") -> str:
    return f"min(CASE WHEN {upto} > floor({q!r}::double * ({all_} - 1)::double + 0.5) THEN {value} END)"


def _projected() -> str:
    return "round(" + " + ".join(["0.0::double", *[f"{e!r}::double * (c{i} - {m!r}::double)" for i, (e, m) in enumerate(zip(DIRECTION, MEAN, strict=True))]]) + ", 12)"


def _decoder_fit() -> str:
    """The weighted normal equations of all sites, eliminated column by column (six unknowns, three right-hand sides)."""
    phi, targets = ["z0", "z1", "s0", "s0 * z0", "s0 * z1", "1.0::double"], ["t0", "t1", "t2"]
    n, width = len(phi), len(phi) + len(targets)
    sums = ", ".join("[" + ", ".join(f"sum(wt * ({a}) * ({b}))" for b in (*phi, *targets)) + "]" for a in phi)
    trace = " + ".join(f"a[{i}][{i}]" for i in range(1, n + 1))
    cell = lambda i, j: f"a[{i}][{j}]" + (f" + 1e-9::double * ({trace}) / {n}" if i == j else "")
    matrix = lambda entry: "[" + ", ".join("[" + ", ".join(entry(i, j) for j in range(1, width + 1)) + "]" for i in range(1, n + 1)) + "] AS a"
    steps = [f"e0 AS (SELECT {matrix(cell)} FROM sums)"]
    for k in range(1, n + 1):
        entry = lambda i, j, k=k: f"a[{k}][{j}] / a[{k}][{k}]" if i == k else f"a[{i}][{j}] - a[{i}][{k}] * a[{k}][{j}] / a[{k}][{k}]"
        steps.append(f"e{k} AS (SELECT {matrix(entry)} FROM e{k - 1})")
    solved = lambda i, r: f"round(a[{i}][{n + r + 1}]::float::double, 4)"
    rows = " UNION ALL ".join(f"SELECT {r} AS output, {', '.join(f'{solved(i + 1, r)} AS w{i}' for i in range(n - 1))}, {solved(n, r)} AS bias FROM e{n}" for r in range(len(targets)))
    shares = "shares AS (SELECT plane, CASE WHEN plane = 0 THEN 0.5::double ELSE 0.5::double * r / sum(r) OVER () END / ((w0 * h0)::double * 5) AS wt FROM (SELECT *, CASE WHEN plane = 0 THEN 0 ELSE (w0 * h0)::double END AS r FROM size))"
    return f"{_head(LEVELS, ',' + _sites())}, {shares}, sums AS (SELECT [{sums}] AS a FROM rows_ JOIN shares USING (plane)), {', '.join(steps)} {rows}"


def _leading_direction() -> str:
    """The covariance of the block means squared until only its leading direction is left; every mean projected on it."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    name = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    squared = ", ".join(f"{' + '.join(f'{name(i, k)} * {name(k, j)}' for k in range(3))} AS {name(i, j)}" for i, j in pairs)
    shared = lambda q: ", ".join(f"{name(i, j)} / ({' + '.join(name(k, k) for k in range(3))})" for i, j in pairs) + f" FROM {q}"
    largest = [f"WHEN {name(i, i)} = greatest(m00, m11, m22) THEN [{', '.join(f'{name(i, j)} / sqrt({name(i, i)})' for j in range(3))}]" for i in range(3)]
    start = ", ".join(f"covar_pop(c{i}, c{j}) AS {name(i, j)}" for i, j in pairs)
    return f"""{_head()},
cov AS (SELECT {start} FROM means),
sq(n, {', '.join(name(i, j) for i, j in pairs)}) AS (SELECT 0, {shared('cov')} UNION ALL SELECT n + 1, {shared(f'(SELECT n, {squared} FROM sq WHERE n < 40)')}),
dir AS (SELECT CASE {' '.join(largest)} END AS e FROM sq WHERE n = 40),
mu AS (SELECT avg(c0) AS a0, avg(c1) AS a1, avg(c2) AS a2 FROM means),
p AS (SELECT x, y, {' + '.join(f'e[{i + 1}] * (c{i} - a{i})' for i in range(3))} AS p FROM means, dir, mu)
SELECT x, y, round(p / (SELECT max(abs(p)) FROM p), 6) AS v FROM p"""


def _closed(bits: int) -> str:
    v = "round(2 * v - 1, 9)"
    return f"SELECT plane, ch, count(*)::bigint AS n, 0::bigint AS off_grid, 0::bigint AS not_closed, {bits} AS bits FROM (SELECT plane, {v} AS q, ch FROM (SELECT plane, unnest([0, 1, 2])::int AS ch, unnest([c0, c1, c2]) AS v FROM ev)) GROUP BY plane, ch"


def _palette(bits: int, block: bool) -> str:
    share = f"k::double / {(1 << bits) - 1}" if block else f"{_replicate('k', bits)}::double / 255"
    return f"SELECT {bits} AS bits, {str(block).lower()} AS block, k, (-1 + 2 * ({share}))::float::double AS value FROM (SELECT unnest(range({1 << bits}))::int AS k)"


def _descriptors() -> str:
    rows = ", ".join(f"('{name}', '{text}'::JSON)" for name, text in _DESCRIPTORS)
    rules = {
        "(c0 NOT BETWEEN 1 AND 4) OR (c1 NOT BETWEEN 1 AND 4)": "1 to 4 channels per latent",
        "nin <> c1 + c0 + c0 * c1": "nin is C1 + C0 + C0 * C1",
        "nout <> 3 * outputs": "three outputs per texture",
        "json_array_length((layer->'weights')) <> nin * nout": "as many weights as nin times nout",
        "json_array_length((layer->'bias')) <> nout": "as many biases as outputs",
        "(t0->>'mip_count')::int <> (t1->>'mip_count')::int": "equal mip counts",
        "json_array_length((t0->'mip_sizes')) <> ((t0->>'mip_count')::int) OR json_array_length((t1->'mip_sizes')) <> ((t1->>'mip_count')::int)": "a size for every mip",
    }
    cases = ", ".join(f"CASE WHEN {bad} THEN '{text}' END" for bad, text in rules.items())
    return f"""WITH raw(name, j) AS (VALUES {rows}),
d AS (
  SELECT name, j, (j->'decoder'->>'C0')::int AS c0, (j->'decoder'->>'C1')::int AS c1, (j->'decoder'->>'nin')::int AS nin, (j->'decoder'->>'nout')::int AS nout,
    (j->'decode'->>'textures_out')::int AS outputs, j->'decoder'->'layers'->0 AS layer, j->'textures'->0 AS t0, j->'textures'->1 AS t1
  FROM raw WHERE (j->'decoder') IS NOT NULL AND json_array_length(j->'textures') = 2 AND (j->>'format') IS NOT NULL),
broken AS (SELECT name, NULL::varchar AS file, unnest([{cases}]) AS state FROM d),
latent AS (SELECT name, unnest([t0, t1]) AS t FROM d),
named AS (SELECT name, unnest(CASE WHEN (t->'files') IS NOT NULL THEN (t->'files')::varchar[] ELSE [t->>'file'] END) AS file FROM latent)
SELECT * FROM broken WHERE state IS NOT NULL
UNION ALL SELECT name, file, CASE WHEN contains(file, '/') THEN 'unresolvable' WHEN file IN ('a.dds', 'b.dds', 'e.dds') THEN 'have' ELSE 'missing' END FROM named"""


_SETTINGS = """WITH textures(t, filter, srgb, edge, normal_map, weight) AS (VALUES
  (0, NULL, NULL::boolean, NULL, NULL::boolean, 500.0::double), (1, 'mitchell', true, NULL, NULL, NULL), (2, NULL, true, NULL, NULL, 1e-9::double), (3, 'box', NULL, 'wrap', true, 0.0::double)),
given(t, f, w) AS (VALUES (0, 'catmullrom', NULL::double), (1, NULL, 2.0::double)),
j AS (SELECT *, coalesce(srgb, false) OR coalesce(edge, 'clamp') = 'wrap' OR coalesce(normal_map, false) AS implied, coalesce(w, weight, 1.0::double) AS raw FROM textures LEFT JOIN given USING (t))
SELECT t, CASE WHEN f IS NULL AND filter IS NULL AND implied THEN 'box' ELSE coalesce(f, filter, 'default') END AS filter,
  CASE WHEN f IS NOT NULL THEN 'command line' WHEN filter IS NOT NULL THEN 'file' WHEN implied THEN 'implied' ELSE 'default' END AS filter_from,
  coalesce(srgb, false) AS srgb, coalesce(edge, 'clamp') AS edge, coalesce(normal_map, false) AS normal_map,
  CASE WHEN raw <= 0 THEN 0.0::double ELSE greatest(1e-6::double, least(128.0::double, raw)) END AS weight,
  CASE WHEN w IS NOT NULL THEN 'command line' WHEN weight IS NOT NULL THEN 'file' ELSE 'default' END AS weight_from
FROM j"""


def _report(other: dict[str, str], objective: str) -> str:
    """The account of a fit out of the SQL of its parts."""
    parts = [
        f"SELECT 'psnr' AS name, plane, texture, psnr AS value FROM ({other['q36_psnr']}) WHERE plane = 0 AND texture >= 0",
        f"SELECT 'mip psnr', plane, -1, psnr FROM ({other['q36_psnr']}) WHERE plane > 0 AND texture = -1",
        *[f"SELECT 'worst case {c}', plane, -1, {c}::double FROM ({other['q37_worst_case']}) WHERE plane = 0" for c in ("p50", "p90", "p99", "max", "above8")],
        f"SELECT 'weight', plane, -1, share FROM ({other['q18_mip_weights']}) WHERE kind = 'pixels'",
        *[f"SELECT '{n}', -1, -1, {v} FROM ({objective})" for n, v in (("e", "e"), ("centre psnr", "-10 * log10(centre_mse)"), ("sampled psnr", "-10 * log10(sampled_mse)"))],
        *[f"SELECT '{c}', -1, -1, {c}::double FROM ({other['q41_rates']})" for c in ("bytes", "bpp_base", "bpp_chain", "bpp_texture")],
    ]
    return f"SELECT name, plane::int AS plane, texture::int AS texture, round(value, 5) AS value FROM ({' UNION ALL '.join(parts)})"


def oracle_sql() -> dict[str, str]:
    bytes3 = ", ".join(f"{_byte(f'c{i}')} AS c{i}" for i in range(3))
    linear = lambda c: f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92::double ELSE pow(({c} + 0.055::double) / 1.055::double, 2.4::double) END"
    back = lambda c: f"CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92::double WHEN {c} >= 1 THEN 1 ELSE 1.055::double * pow({c}, {1 / 2.4!r}::double) - 0.055::double END"
    clamp = lambda c: f"least(1.0::double, greatest(0.0::double, {c}))"
    normal = [f"(2 * c{i} - 1)" for i in range(3)]
    length = f"sqrt({' + '.join(f'{n} * {n}' for n in normal)})"
    energy = lambda k: " + ".join(f"{c!r}::double * ({o} - c{i}) * ({o} - c{i})" for i, (c, o) in enumerate(zip(CW, _outputs("pv"), strict=True)))
    regr = ", ".join(f"round(regr_slope(c{i}, z0), 6) AS slope{i}, round(regr_intercept(c{i}, z0), 6) AS intercept{i}" for i in range(3))
    det = "(var_pop(z0) * var_pop(z1) - covar_pop(z0, z1) * covar_pop(z0, z1))"
    a = lambda i: f"((covar_pop(z0, c{i}) * var_pop(z1) - covar_pop(z1, c{i}) * covar_pop(z0, z1)) / {det})"
    b = lambda i: f"((covar_pop(z1, c{i}) * var_pop(z0) - covar_pop(z0, c{i}) * covar_pop(z0, z1)) / {det})"
    two = ", ".join(f"round({a(i)}, 6) AS c{i}_z0, round({b(i)}, 6) AS c{i}_z1, round(avg(c{i}) - {a(i)} * avg(z0) - {b(i)} * avg(z1), 6) AS c{i}_b" for i in range(3))
    lean = []
    for k in range(3):
        own = [W[i][k] for i in range(3)]
        lean.append(f"SELECT 0 AS texture, '{'level1' if k < 2 else 'level0'}' AS level, {k if k < 2 else k - 2} AS channel, round(sqrt(({' + '.join(f'{v!r}::double * {v!r}::double' for v in own)}) / 3), 9) AS rms")
    kinds = {"uniform": "1.0::double", "sqrt": "sqrt(w0 * h0)", "pixels": "(w0 * h0)::double"}
    mips = lambda kind, mix=0.5: f"SELECT plane, CASE WHEN plane = 0 THEN {1 - mix!r}::double ELSE {mix!r}::double * r / sum(r) OVER () END AS share, w0 * h0 AS px, '{kind}' AS kind FROM (SELECT *, CASE WHEN plane = 0 THEN 0 ELSE {kinds[kind]} END AS r FROM size)"
    site_offsets = lambda k, o: f"SELECT x, y, j, {_TURNED_X if k != 2 else 'ox'} AS dx, {_TURNED_Y if k != 2 else 'oy'} AS dy, {k} AS k FROM px, (VALUES (0, 0.0::double, 0.0::double), {o}) o(j, ox, oy)"
    lod = f"greatest(0.0::double, least(lod, {LEVELS}))"
    own_lod = ", ".join(f"sum(f * r{i}) AS {c}" for i, c in enumerate("rgb"))
    objective = lambda digits: f"""{_head(LEVELS, ',' + _sites())},
sums AS (SELECT plane, sum({_weighted()}) AS weighted, sum(CASE WHEN j = 0 THEN {_error()} ELSE 0 END) AS centre, sum(CASE WHEN j > 0 THEN {_error()} ELSE 0 END) AS fractional FROM rows_ GROUP BY plane),
m AS ({mips('pixels')})
SELECT round(sum(share / (px::double * 5) * weighted) / ({sum(CW)!r}::double * sum(share / (px::double * 5) * px * 5)), {digits}) AS e,
  round(sum(CASE WHEN plane = 0 THEN centre / (px::double * 3) END), {digits}) AS centre_mse, round(sum(CASE WHEN plane = 0 THEN fractional / (px::double * 12) END), {digits}) AS sampled_mse
FROM sums JOIN m USING (plane)"""  # noqa: E731
    out = {
        "q01_events_raster": f"WITH {_EVENTS} SELECT plane, x, y, {bytes3} FROM ev",
        "q02_material_pack": f"WITH {_BOTH} SELECT e.plane, e.x, e.y, {', '.join(f'{_byte(f"e.c{i}")} AS c{i}, {_byte(f"o.c{i}")} AS c{i + 3}' for i in range(3))} FROM evf e JOIN odf o USING (x, y)",
        "q03_channel_insert_long": f"WITH {_BOTH} SELECT o.plane, o.x, o.y, unnest([0, 1, 2, 3, 4, 5])::int AS ch, unnest([{', '.join(_byte(f'o.c{i % 3}') for i in range(6))}]) AS v FROM evf e JOIN odf o USING (x, y)",
        "q04_pad": f"WITH {_EVENTS}, grid AS (SELECT px, py, least(px, w - 1) AS x, least(py, h - 1) AS y FROM dims, (SELECT unnest(range((SELECT (w + 3) // 4 * 4 FROM dims)))::int AS px), (SELECT unnest(range((SELECT (h + 3) // 4 * 4 FROM dims)))::int AS py)) SELECT plane, px AS x, py AS y, {bytes3} FROM grid JOIN ev USING (x, y)",
        "q05_plane_geometry": f"WITH RECURSIVE {_EVENTS}, {_geometry(None)} SELECT * FROM size",
        "q06_box_sums": f"WITH {_EVENTS} SELECT (x // 2)::int AS x, (y // 2)::int AS y, {', '.join(f'sum({_byte(f"c{i}")})::int AS sum{i}' for i in range(3))} FROM ev, dims WHERE x < w // 2 * 2 AND y < h // 2 * 2 GROUP BY x // 2, y // 2",
        "q07_box_chain": f"{_head(LEVELS)} SELECT plane, x, y, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM src WHERE plane > 0",
        "q08_mitchell_clamp": _resize("mitchell", "clamp"),
        "q09_catmullrom_wrap": _resize("catmullrom", "wrap"),
        "q10_linear_light_box": f"WITH {_EVENTS}, lin AS (SELECT plane, x, y, {', '.join(f'{linear(f"c{i}")} AS c{i}' for i in range(3))} FROM ev), half AS (SELECT plane, (x // 2)::int AS x, (y // 2)::int AS y, avg(c0) AS c0, avg(c1) AS c1, avg(c2) AS c2 FROM lin, dims WHERE x < w // 2 * 2 AND y < h // 2 * 2 GROUP BY plane, x // 2, y // 2) SELECT plane, x, y, {', '.join(f'round({clamp(back(f"c{i}"))}, 6) AS c{i}' for i in range(3))} FROM half",
        "q11_normal_renorm": f"WITH {_EVENTS} SELECT plane, x, y, {', '.join(f'round(CASE WHEN {length} > 0.5 AND {normal[2]} > 0 THEN {clamp(f"{normal[i]} / {length} * 0.5::double + 0.5::double")} ELSE c{i} END, 6) AS c{i}' for i in range(3))} FROM ev",
        "q12_fit": f"WITH {_EVENTS}, plan AS (SELECT CASE WHEN w <= 64 THEN 0 ELSE greatest(0, least(w - 64, (w - 64) // 2 + 3)) END AS x0, least(w, 64) AS nw, CASE WHEN h <= 128 THEN 0 ELSE greatest(0, least(h - 128, (h - 128) // 2)) END AS y0, least(h, 128) AS nh FROM dims), grid AS (SELECT px, py, x0 + least(px, nw - 1) AS x, y0 + least(py, nh - 1) AS y FROM plan, (SELECT unnest(range(64))::int AS px), (SELECT unnest(range(128))::int AS py)) SELECT plane, px AS x, py AS y, {bytes3} FROM grid JOIN ev USING (x, y)",
        "q13_block_means": f"{_head()} SELECT plane, x, y, round(c0, 9) AS c0, round(c1, 9) AS c1, round(c2, 9) AS c2 FROM means",
        "q14_bilinear_gather": f"{_head(0, ',' + _level1('l0'))} SELECT plane, x, y, round(z0, 9) AS z0, round(z1, 9) AS z1 FROM z",
        "q15_sites": f"WITH {_EVENTS}, px AS (SELECT x, y FROM ev) {site_offsets(1, '(1, 0.25::double, 0.25::double)')} UNION ALL {site_offsets(2, '(1, -0.25::double, 0.25::double), (2, 0.25::double, -0.25::double)')} UNION ALL {site_offsets(4, '(1, -0.375::double, -0.125::double), (2, -0.125::double, 0.375::double), (3, 0.125::double, -0.375::double), (4, 0.375::double, 0.125::double)')}",
        "q16_trilinear": f"""{_head(LEVELS)},
pts AS (SELECT id, (id * 37 % 1000)::double / 1000 AS u, (id * 91 % 997)::double / 997 AS v, (id % 31)::double / 10 AS lod FROM (SELECT unnest(range(2000)) AS id)),
two AS (SELECT id, u, v, floor({lod})::int AS plane, 1 - ({lod} - floor({lod})) AS f FROM pts UNION ALL SELECT id, u, v, least(floor({lod})::int + 1, {LEVELS}), {lod} - floor({lod}) FROM pts),
{_gather('r', 'two', 'src', {'r0': 'c0', 'r1': 'c1', 'r2': 'c2'}, 'u * w0 - 0.5::double', 'v * h0 - 0.5::double', 'w0', 'h0', 'id, plane, f')},
s AS (SELECT id, {own_lod} FROM r GROUP BY id)
SELECT id, round(r, 9) AS r, round(g, 9) AS g, round(b, 9) AS b FROM s""",
        "q51_repeated_points": f"""{_head(LEVELS)},
pts AS (SELECT id, (id % 500 * 37 % 100)::double / 100 AS u, (id % 500 * 91 % 97)::double / 97 AS v, (id % 500 % 7)::double / 2 AS lod FROM (SELECT unnest(range(2000)) AS id)),
two AS (SELECT id, u, v, floor({lod})::int AS plane, 1 - ({lod} - floor({lod})) AS f FROM pts UNION ALL SELECT id, u, v, least(floor({lod})::int + 1, {LEVELS}), {lod} - floor({lod}) FROM pts),
{_gather('r', 'two', 'src', {'r0': 'c0', 'r1': 'c1', 'r2': 'c2'}, 'u * w0 - 0.5::double', 'v * h0 - 0.5::double', 'w0', 'h0', 'id, plane, f')},
s AS (SELECT id, {own_lod} FROM r GROUP BY id)
SELECT round(u, 9) AS u, round(v, 9) AS v, round(lod, 9) AS lod, round(r, 9) AS r, round(g, 9) AS g, round(b, 9) AS b FROM s JOIN pts USING (id)""",
        "q55_gradient_sampling": _gradient_sampling((("bilinear", 4.0, 5), ("trilinear", 4.0, 5), ("point", 1.0, 3)), True),
        "q56_anisotropic_sampling": _gradient_sampling((("anisotropic", 4.0, 5),), False),
        "q17_objective_sums": f"{_head(0, ',' + _sites())} SELECT j, count(*)::bigint AS n, round(sum(s0), 6) AS sum_s, round(sum(s0 * z0), 6) AS sum_sz, round(sum(z0 * t0), 6) AS sum_zt, round(sum({_error()}), 6) AS se FROM rows_ GROUP BY j",
        "q18_mip_weights": f"WITH RECURSIVE {_EVENTS}, {_geometry(LEVELS)}, m AS ({' UNION ALL '.join(mips(k) for k in kinds)}) SELECT plane, round(share, 12) AS share, round(share / (px::double * 5), 12) AS per_site, kind FROM m",
        "q19_objective": objective(9),
        "q20_decoder_one_feature": f"{_head(0, ',' + _level1('src', 'plane, x, y, c0, c1, c2'))} SELECT {regr} FROM z",
        "q21_decoder_two_features": f"{_head(0, ',' + _level1('src', 'plane, x, y, c0, c1, c2'))} SELECT {two} FROM z",
        "q23_covariance": f"{_head()} {' UNION ALL '.join(f'SELECT {i} AS i, {j} AS j, round(avg(c{i}), 9) AS mean_i, round(covar_pop(c{i}, c{j}), 9) AS cov FROM means' for i in range(3) for j in range(3))}",
        "q25_projection_histogram": f"WITH {_EVENTS}, p AS (SELECT {_projected()} AS p FROM ev), k AS (SELECT max(abs(p)) AS peak FROM p), b AS (SELECT least(255, floor(abs(p) / peak * 256)::int) AS bin, peak, count(*) AS n FROM p, k GROUP BY ALL), c AS (SELECT *, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM b) SELECT min(bin)::int AS bin, round(any_value(peak) * (min(bin) + 1)::double / 256, 9) AS divisor FROM c WHERE upto >= floor(0.99::double * total)",
        "q26_value_range": f"{_head()}, v AS (SELECT unnest([0, 1, 2])::int AS ch, round(unnest([c0, c1, c2]), 9) AS v FROM means), r AS (SELECT ch, v, row_number() OVER (PARTITION BY ch ORDER BY v) AS upto, count(*) OVER (PARTITION BY ch) AS total FROM v) SELECT ch, {_rank(0.001, 'v')} AS lo, {_rank(0.999, 'v')} AS hi, 'pct' AS policy FROM r GROUP BY ch UNION ALL SELECT ch, min(v), max(v), 'minmax' FROM v GROUP BY ch",
        "q27_grid_snap": f"WITH {_EVENTS}, q AS (SELECT x, y, round(2 * c0 - 1, 9) AS v FROM ev), u AS (SELECT DISTINCT v FROM q), k AS (SELECT v, {', '.join(f'{_grid_index(b_, "v")}::int AS k{b_}' for b_ in range(3, 9))} FROM u) SELECT x, y, {', '.join(f'k{b_}' for b_ in range(3, 9))}, {', '.join(f'{_grid_value(b_, f"k{b_}")} AS v{b_}' for b_ in (3, 5, 8))} FROM q JOIN k USING (v)",
        "q28_palettes": " UNION ALL ".join(_palette(bits, block) for bits in range(1, 5) for block in (False, True)),
        "q29_grid_closure": f"WITH {_EVENTS} {' UNION ALL '.join(_closed(bits) for bits in range(4, 9))}",
        "q30_block_pack": f"""{_blocks(4)},
packed AS (SELECT ch, bx, yb, r0, r1, sum(sel::bigint << (3 * t))::bigint AS bits, sum(CASE WHEN r0 = r1 THEN 0 ELSE (value - (v * 255.0::double / 15)::float::double) ** 2 END) AS se FROM near GROUP BY ALL)
SELECT ch, bx::int AS bx, yb::int AS "by", r0, r1, bits, printf('%02x%02x', r0, r1) || {' || '.join(f"printf('%02x', (bits >> {8 * i}) & 255)" for i in range(6))} AS bytes, round(se, 3) AS se FROM packed""",
        "q31_block_decode": f"{_blocks(4)} SELECT ch, px AS x, py AS y, round(CASE WHEN r0 = r1 THEN r0 ELSE value END, 4) AS v FROM near WHERE px < w AND py < h",
        "q32_packing_error": f"{_blocks(4)}, e AS (SELECT ch, count(*)::bigint AS n, sum((CASE WHEN r0 = r1 THEN r0 ELSE value END - v * 255.0::double / 15) ** 2) AS se FROM near WHERE px < w AND py < h GROUP BY ch) SELECT ch, n, round(se, 3) AS se, round({_psnr_of('se / n')}, 3) AS psnr FROM e",
        "q33_lossless_relabel": f"WITH {_EVENTS} {' UNION ALL '.join(_relabel(bits) for bits in (1, 2, 3))}",
        "q34_palette_argmin": f"{_head(0, ',' + _level1('src', 'plane, x, y, c0, c1, c2'))}, cand AS (SELECT z.*, k, (-1 + 2 * ({_replicate('k', 4)}::double / 255))::float::double AS pv FROM z, (SELECT unnest(range(16))::int AS k)), en AS (SELECT x, y, k, pv, round({energy('k')}, 12) AS energy FROM cand) SELECT x, y, arg_min(k, (energy, k)) AS k, round(arg_min(pv, (energy, k)), 7) AS value, round(min(energy), 7) AS energy FROM en GROUP BY x, y",
        "q35_decode": f"{_decoded(0)} SELECT plane, x, y, {bytes3} FROM out",
        "q36_psnr": f"{_decoded(LEVELS)}, {_errors('src', 'out')}, m AS (SELECT plane, avg((d * d)::double) AS mse FROM err GROUP BY plane) SELECT plane, 0 AS texture, round(mse, 6) AS mse, round({_psnr_of('mse')}, 6) AS psnr FROM m UNION ALL SELECT plane, -1, NULL, round({_psnr_of('mse')}, 6) FROM m",
        "q37_worst_case": f"{_decoded(LEVELS)}, {_errors('src', 'out')}, pk AS (SELECT plane, x, y, max(abs(d)) AS peak FROM err GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY plane ORDER BY peak) AS upto, count(*) OVER (PARTITION BY plane) AS total FROM pk) SELECT plane, {_rank(0.5, 'peak')} AS p50, {_rank(0.9, 'peak')} AS p90, {_rank(0.99, 'peak')} AS p99, max(peak) AS max, round(100 * avg(CASE WHEN peak > 8 THEN 1.0::double ELSE 0 END), 6) AS above8 FROM r GROUP BY plane",
        "q38_channel_stats": f"{_head(LEVELS)}, v AS (SELECT plane, unnest([0, 1, 2])::int AS ch, unnest([c0, c1, c2]) AS v FROM src) SELECT plane, ch, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS most, round(100 * avg(CASE WHEN abs(v) <= 2e-6 OR abs(v - 1) <= 2e-6 THEN 1.0::double ELSE 0 END), 6) AS ends FROM v GROUP BY plane, ch",
        "q39_frame_diff": f"WITH {_BOTH}, {_errors('evf', 'odf')} SELECT plane, ch, max(abs(d)) AS max_diff, round(avg(abs(d)), 6) AS mean_diff, round(avg((d * d)::double), 6) AS mse, round({_psnr_of('avg((d * d)::double)')}, 6) AS psnr FROM err GROUP BY plane, ch",
        "q40_duplicate_channels": f"WITH {_EVENTS}, c AS (SELECT [c0, c1, c2, c0, c2] AS v FROM ev) SELECT a::int AS a, b::int AS b, bool_and(v[a + 1] = v[b + 1]) AS same FROM c, (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b) WHERE a < b GROUP BY a, b",
        "q22_decoder_fit": _decoder_fit(),
        "q24_leading_direction": _leading_direction(),
        "q52_asset_round_trip": f"{_asset()}, {_errors('src', 'out')}, m AS (SELECT plane, avg((d * d)::double) AS mse FROM err GROUP BY plane) SELECT plane, 0 AS texture, round(mse, 6) AS mse, round({_psnr_of('mse')}, 6) AS psnr FROM m UNION ALL SELECT plane, -1, NULL, round({_psnr_of('mse')}, 6) FROM m",
        "q53_asset_closure": f"{_head(LEVELS)}, {_stored()}, v AS (SELECT plane, unnest([0, 1])::int AS ch, unnest([v0, v1]) AS v FROM l1q) SELECT plane, ch, count(*)::bigint AS n, 0::bigint AS off_grid, 0::bigint AS not_closed, round(sum(v), 5) AS total FROM v GROUP BY plane, ch",
        "q41_rates": f"WITH RECURSIVE {_EVENTS}, {_geometry(LEVELS)}, b AS (SELECT plane, ceil(w0 / 4.0) * ceil(h0 / 4.0) * 16 + w1 * h1 * 4 AS n, w, h FROM size, dims) SELECT sum(n)::bigint AS bytes, round(sum(CASE WHEN plane = 0 THEN n ELSE 0 END)::double * 8 / max(w::double * h), 9) AS bpp_base, round(sum(n)::double * 8 / max(w::double * h), 9) AS bpp_chain, round(sum(n)::double * 8 / max(w::double * h), 9) AS bpp_texture FROM b",
        "q42_descriptor_files": _descriptors(),
        "q43_settings_merge": _SETTINGS,
        "q48_decoder_lean": " UNION ALL ".join(lean),
        "q49_lineitem_raster": "WITH grid AS (SELECT unnest(range(4096)) AS id), cells AS (SELECT (l_partkey % 64)::int AS x, (l_suppkey % 64)::int AS y, (count(*) % 256)::int AS r, (sum(l_quantity)::bigint % 256)::int AS g FROM lineitem GROUP BY ALL) SELECT 0 AS plane, (id % 64)::int AS x, (id // 64)::int AS y, coalesce(r, 0) AS c0, coalesce(g, 0) AS c1 FROM grid LEFT JOIN cells ON cells.x = id % 64 AND cells.y = id // 64",
        "q50_embeddings_box": f"WITH em AS (SELECT unnest(range(64))::int AS x, vec_id::int AS y, greatest(0.0::double, least(1.0::double, 0.5::double + unnest(embedding)::double)) AS c0 FROM embeddings), dims AS (SELECT count(*)::int AS h FROM embeddings), half AS (SELECT x // 2 AS hx, y // 2 AS hy, avg(c0) AS m FROM em, dims WHERE y < h // 2 * 2 GROUP BY ALL), e AS (SELECT x, abs({_byte('c0')} - {_byte('round(m, 9)')}) AS d FROM em JOIN half ON x // 2 = hx AND y // 2 = hy) SELECT (x // 16)::int AS band, max(d) AS max_diff, round(avg((d * d)::double), 6) AS mse, count(*)::bigint AS n FROM e GROUP BY ALL",
    }
    out["q58_report"] = _report(out, objective(15))
    from rasterloom import fit_queries, picture_queries, setting_queries

    return out | fit_queries.oracle_sql() | setting_queries.oracle_sql() | picture_queries.oracle_sql()
