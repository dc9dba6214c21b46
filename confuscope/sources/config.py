"""Settings and the registry of scripts. Everything here is small and lives on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession

# The characters of the four built-in scripts, and the engines.
DIGITS = "0123456789"
COMMON = ".,!?;:'\"-()[]{}/ "
LATIN = "abcdefghijklmnopqrstuvwxyz" "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω" "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ" "άέήίόύώϊϋΐΰ"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя" "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ" "ёЁ"
ARABIC = "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوى" "ـ" "ًٌٍَُِّْ" "ٰٕٓٔ" "٠١٢٣٤٥٦٧٨٩" "،؛؟!-( )" "ـــ"
ENGINES = ("tesseract", "easyocr", "trocr", "paddle", "surya", "glm")


@dataclass(frozen=True)
class Language:
    charset: str
    engines: frozenset[str] = frozenset({"trocr"})


LANGUAGES: dict[str, Language] = {
    "latin": Language(LATIN + DIGITS + COMMON, frozenset(ENGINES)),
    "greek": Language(GREEK + DIGITS + COMMON, frozenset(ENGINES) - {"easyocr"}),
    "cyrillic": Language(CYRILLIC + DIGITS + COMMON, frozenset(ENGINES)),
    "arabic": Language(ARABIC, frozenset(ENGINES)),
}


def register_language(script: str, charset: str, engines: frozenset[str] | set[str] = frozenset({"trocr"})) -> None:
    if not script or not charset:
        raise ValueError("a script has a name and characters")
    LANGUAGES[script] = Language(charset, frozenset(engines))


def get_charset(script: str) -> str:
    """Characters of a script; an unknown one has none, so nothing is filtered."""
    return LANGUAGES[script].charset if script in LANGUAGES else ""


def charset_table(spark: SparkSession, scripts: list[str] | None = None) -> DataFrame:
    """(script, ch)."""
    rows = [(s, c) for s in (scripts or LANGUAGES) for c in sorted(set(get_charset(s)))]
    return spark.createDataFrame(rows, "script string, ch string")


def engine_support() -> dict[str, set[str]]:
    return {e: {s for s, lang in LANGUAGES.items() if e in lang.engines} for e in ENGINES}


def supported(engine: str, scripts: list[str]) -> list[str]:
    """The scripts that the engine knows, in order; none left or an unknown script raises."""
    unknown = set(scripts) - LANGUAGES.keys()
    if unknown:
        raise ValueError(f"unknown scripts: {sorted(unknown)}")
    kept = [s for s in scripts if engine in LANGUAGES[s].engines]
    if not kept:
        raise ValueError(f"{engine} supports none of {scripts}")
    return kept


@dataclass
class OcrSettings:
    engine: str = "surya"
    psm: int = 6
    oem: int = 3
    device: str = "cpu"
    batch_size: int = 32


@dataclass
class ImageSettings:
    min_width: int = 100
    min_height: int = 50
    max_width: int = 4000
    max_height: int = 3000
    formats: tuple[str, ...] = (".png", ".jpg", ".jpeg", ".tiff", ".bmp")


@dataclass
class MatchSettings:
    case_sensitive: bool = True
    normalize_unicode: bool = True


@dataclass
class SegmentSettings:
    chars: int = 100
    shortest: int = 20
    lines: int = 5
    cap: int | None = None


@dataclass
class PipelineSettings:
    input_dir: str = "data/raw/images"
    truth_dir: str = "data/raw/ground_truth"
    output_dir: str = "data/confusion_matrices"
    scripts: list[str] = field(default_factory=lambda: ["latin", "greek", "cyrillic", "arabic"])
    ocr: OcrSettings = field(default_factory=OcrSettings)
    image: ImageSettings = field(default_factory=ImageSettings)
    match: MatchSettings = field(default_factory=MatchSettings)
    segment: SegmentSettings = field(default_factory=SegmentSettings)

    def __post_init__(self) -> None:
        self.scripts = supported(self.ocr.engine, self.scripts)
        # A shared base folder gets a folder for each engine.
        if self.output_dir.rstrip("/").rpartition("/")[2] in ("confusion_matrices", "outputs"):
            self.output_dir = f"{self.output_dir.rstrip('/')}/{self.ocr.engine}"


def _build(kind: type, values: dict):
    known = {f.name: f for f in fields(kind)}
    unknown = values.keys() - known.keys()
    if unknown:
        raise TypeError(f"unknown settings for {kind.__name__}: {sorted(unknown)}")
    parts = {"ocr": OcrSettings, "image": ImageSettings, "match": MatchSettings, "segment": SegmentSettings}
    return kind(**{k: _build(parts[k], v) if k in parts and isinstance(v, dict) else tuple(v) if k == "formats" else v for k, v in values.items()})


def settings_from_yaml(text: str) -> PipelineSettings:
    """Strict: an unknown key raises TypeError."""
    import yaml

    return _build(PipelineSettings, yaml.safe_load(text) or {})


def settings_to_yaml(settings: PipelineSettings) -> str:
    import yaml

    plain = lambda x: {f.name: plain(getattr(x, f.name)) for f in fields(x)} if is_dataclass(x) else list(x) if isinstance(x, tuple) else x
    return yaml.safe_dump(plain(settings), allow_unicode=True, sort_keys=False)
