"""Small scalar families: durations, labels, quoting, templates, back-off, names in natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_seconds(x: Column) -> Column:
    """Seconds of an ISO-8601 PT… duration; 0 for anything else."""
    part = lambda unit: F.coalesce(F.regexp_extract(F.trim(x), rf"^PT(?:[\d.]+[HMS])*?([\d.]+){unit}", 1).try_cast("double"), F.lit(0.0))
    ok = F.trim(x).rlike(r"^PT(?:\d+(?:\.\d+)?H)?(?:\d+(?:\.\d+)?M)?(?:\d+(?:\.\d+)?S)?$")
    return F.when(F.coalesce(ok, F.lit(False)), part("H") * 3600 + part("M") * 60 + part("S")).otherwise(0.0)


def _tenths(bandwidth: Column) -> Column:
    """Tenths of a Mbps as printf's %.1f rounds them: by the double's exact value, of two equally near ones to the even one.

    format_string rounds the shortest decimal that stands for the double, so 1.95, which is a little less as a double, became 2.0.
    """
    mbps, whole, rest = bandwidth / 1_000_000, F.floor(bandwidth / 100_000), bandwidth % 100_000
    # twenty times the double against the odd number in the middle; all three terms are exact
    side = mbps * 4 - (whole * 2 + 1 - mbps * 16)
    up = (rest > 50_000) | ((rest == 50_000) & ((side > 0) | ((side == 0) & (whole % 2 == 1))))
    return whole + up.cast("int")


def variant_label(height: Column, bandwidth: Column) -> Column:
    """1080p · 5.2 Mbps; only the rate where no height is known; kbps below 1 Mbps."""
    n = _tenths(bandwidth)
    rate = F.when(bandwidth >= 1_000_000, F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit(" Mbps"))).otherwise(F.concat(F.floor(bandwidth / 1000 + 0.5).cast("string"), F.lit(" kbps")))
    return F.when(F.coalesce(height, F.lit(0)) > 0, F.concat(height.cast("string"), F.lit("p · "), rate)).otherwise(rate)


def quality_target(name: Column, auto: int = 720) -> Column:
    """highest, lowest or a height in pixels, for a quality preference; auto and unknown ones give the default height."""
    return F.when(name == "best", "highest").when(name == "worst", "lowest").when(name.rlike(r"^\d+$"), name).otherwise(str(auto))


def shell_quote(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def stream_command(url: Column, engine: str, referer: Column | None = None, agent: Column | None = None, audio_only: bool = False, quality: Column | None = None) -> Column:
    """The command line that would fetch a manifest; its addresses must have no secrets left. Nothing is run."""
    given = lambda prefix, x: F.lit(None).cast("string") if x is None else F.when(x.isNotNull(), F.concat(F.lit(prefix), x))
    quoted = lambda x: None if x is None else shell_quote(x)
    if engine == "ffmpeg":
        header = None if referer is None else shell_quote(F.concat(F.lit("Referer: "), referer))
        tail = "-vn -c:a copy 'out.m4a'" if audio_only else "-c copy 'out.mp4'"
        return F.concat_ws(" ", F.lit("ffmpeg"), given("-user_agent ", quoted(agent)), given("-headers ", header), F.lit("-i"), shell_quote(url), F.lit(tail))
    target = None if quality is None else quality_target(quality)
    pick = F.lit("-x") if audio_only else F.lit(None).cast("string") if target is None else F.when(target.rlike(r"^\d+$"), F.concat(F.lit("-S 'res:"), target, F.lit("'"))).when(target == "lowest", "-S '+res'")
    return F.concat_ws(" ", F.lit("yt-dlp"), pick, given("--referer ", quoted(referer)), given("--user-agent ", quoted(agent)), shell_quote(url))


def dash_template(template: Column, representation: Column, number: Column, time: Column, bandwidth: Column) -> Column:
    """$RepresentationID$, $Number$, $Time$ and $Bandwidth$ filled in, numbers with an optional width; $$ is a dollar sign."""
    out = F.replace(template, F.lit("$$"), F.lit("\x01"))
    for name, value in (("RepresentationID", representation), ("Number", number), ("Time", time), ("Bandwidth", bandwidth)):
        text = F.coalesce(value.cast("string"), F.lit(""))
        width = F.regexp_extract(out, rf"\${name}%0(\d+)d\$", 1)
        wide = F.when(F.length(text) >= width.try_cast("int"), text).otherwise(F.lpad(text, width.try_cast("int"), "0"))
        out = F.when(width != "", F.regexp_replace(out, F.lit(rf"\${name}%0\d+d\$"), wide)).otherwise(out)
        out = F.replace(out, F.lit(f"${name}$"), text)
    return F.replace(out, F.lit("\x01"), F.lit("$"))


def backoff_ms(attempts: Column, cap: int = 30_000) -> Column:
    return F.least(1000 * F.pow(F.lit(2), attempts - 1), F.lit(float(cap))).cast("bigint")


def retry_after_ms(header: Column) -> Column:
    """Milliseconds of a Retry-After in seconds; null for dates and anything else."""
    return (F.regexp_extract(header, r"^\s*(\d{1,9})\s*$", 1).try_cast("bigint") * 1000).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def natural_key(name: Column) -> Column:
    """Sorts as people do: case and accents aside, runs of digits by value (up to 20 of them)."""
    plain = F.regexp_replace(F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"), r"(?<!\d)0+(?=\d)", "")
    return F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def relative_time(then_ms: Column, now_ms: Column) -> Column:
    """now, minutes, hours or days ago; a date beyond a week."""
    age = F.floor((now_ms - then_ms) / 60_000).cast("bigint")
    return (
        F.when(age < 1, "now")
        .when(age < 60, F.concat(age.cast("string"), F.lit("m")))
        .when(age < 1440, F.concat(F.floor(age / 60).cast("string"), F.lit("h")))
        .when(age < 10080, F.concat(F.floor(age / 1440).cast("string"), F.lit("d")))
        .otherwise(F.date_format(F.timestamp_millis(then_ms), "yyyy-MM-dd"))
    )
