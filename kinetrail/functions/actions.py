"""Action tokens, flow matching, schedules, embeddings and rotations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BINS = 256


def digitize(x: Column, bins: int = BINS) -> Column:
    """Number of the bin edges, bins of them evenly from -1 to 1, that are not above the clipped value. A first guess is corrected against its own edges, so exact edges fall as the comparison has it."""
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    step = 2.0 / (bins - 1)
    guess = F.floor((v + 1) / step).cast("int") + 1

    def edge(i: Column) -> Column:
        return F.lit(-1.0) + i * F.lit(step)

    up = F.when((guess < bins) & (edge(guess) <= v), guess + 1).otherwise(guess)
    return F.when(edge(up - 1) > v, up - 1).otherwise(F.least(up, F.lit(bins)))


def action_token(d: Column, vocabulary: int, bins: int = BINS) -> Column:
    return F.lit(vocabulary) + d - (bins + 1)


def token_centre(d: Column, bins: int = BINS) -> Column:
    """Centre of bin d (counted from 1), clipped to the outer bins."""
    return F.lit(-1.0) + (F.least(F.greatest(d - 1, F.lit(0)), F.lit(bins - 2)) + 0.5) * F.lit(2.0 / (bins - 1))


def flow(raw: Column, x: Column, noise: Column, shift: float) -> list[Column]:
    """s (sigmoid of raw, shifted), mixed (1 - s) x + s noise, target noise - x; rounded to six digits."""
    g = 1 / (1 + F.exp(-raw))
    s = shift * g / (1 + (shift - 1) * g)
    return [F.round(s, 6).alias("s"), F.round((1 - s) * x + s * noise, 6).alias("mixed"), F.round(noise - x, 6).alias("target")]


def schedule(steps: int, shift: float = 1.0) -> Column:
    """Times from 1 to 0 in equal steps, shifted: an array of steps entries."""
    t = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: 1 - i / F.lit(float(max(steps - 1, 1))))
    return F.transform(t, lambda v: shift * v / (1 + (shift - 1) * v))


def sinusoid(x: Column, width: int, longest: float = 10_000.0, reach_end: bool = False, cosines_first: bool = False) -> Column:
    """Sines, then cosines, of x at width / 2 falling frequencies from 1 to 1 / longest; the last is reached if asked for (positions of actions), else the next one would be it. Time steps take the cosines
    first. An odd width ends in a 0."""
    half = width // 2
    steps = F.lit(float(max(half - 1, 1) if reach_end else half))
    angles = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: x * F.pow(F.lit(longest), -i / steps))
    both = [F.transform(angles, F.sin), F.transform(angles, F.cos)]
    return F.concat(*(both[::-1] if cosines_first else both), F.array(*[F.lit(0.0)] * (width % 2)).cast("array<double>"))


def grid_embedding(row: Column, column: Column, width: int) -> Column:
    """Embedding of a place in a grid: the column's sinusoid, then the row's, each of half the width (a multiple of four)."""
    if width % 4:
        raise ValueError("the width must be a multiple of four")
    return F.concat(sinusoid(column, width // 2), sinusoid(row, width // 2))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def euler_to_matrix(a: Column, b: Column, c: Column) -> Column:
    """Rotation about x by a, then y by b, then z by c, row by row in an array of nine."""
    ca, sa, cb, sb, cc, sc = F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.cos(c), F.sin(c)
    return F.array(cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa, sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa, -sb, cb * sa, cb * ca)


def matrix_to_rot6d(m: Column) -> Column:
    """The first two rows of a rotation matrix."""
    return F.slice(m, 1, 6)


def transposed(m: Column) -> Column:
    return F.array(*(m[3 * j + i] for i in range(3) for j in range(3)))


def product(a: Column, b: Column) -> Column:
    """Product of two 3 x 3 matrices in arrays of nine."""
    return F.array(*(sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)))


def quaternion_to_euler(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Roll, pitch and yaw of a unit quaternion."""
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x))))
    return F.array(roll, pitch, F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))


def applied(m: Column, v: Column) -> Column:
    """A 3 x 3 matrix in an array of nine times a vector of three."""
    return F.array(*(m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)))


def in_wrist_frame(velocity: Column, pose: Column) -> Column:
    """A velocity (three of translation, three Euler angles) in the base's frame, seen from a wrist of this pose (position, Euler angles): nine numbers, the turned
    translation and the first two rows of the rotation between the wrist's frame before and after."""
    turn = euler_to_matrix(pose[3], pose[4], pose[5])
    change = product(transposed(turn), product(euler_to_matrix(velocity[3], velocity[4], velocity[5]), turn))
    return F.concat(applied(transposed(turn), velocity), matrix_to_rot6d(change))
