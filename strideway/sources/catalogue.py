"""The catalogue of open-data sources: where each comes from, how it is encoded, and whose columns it has."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Source:
    """One dataset. kind: toilet or rest; normaliser: how its columns make records (see operators.normalise)."""

    key: str
    kind: str
    normaliser: str
    provider: str
    name: str
    page: str
    resource: str
    encoding: str
    required: tuple[str, ...]
    licence: str = "CC BY"
    updated: str | None = None

    @property
    def credit(self) -> str:
        return f"{self.provider}「{self.name}」（{self.licence}）"


# Fixed values from here to the end: the publishers' names, addresses, encodings and headings.
WIDE_DOOR = "車椅子が出入りできる（出入口の有効幅員80cm以上）"
CATALOGUE_PAGE, CITY_FILES, METRO_FILES = "https://catalog.data.metro.tokyo.lg.jp/dataset", "https://www.city.shinjuku.lg.jp/content", "https://www.opendata.metro.tokyo.lg.jp"
TOILETS = (
    Source(
        "shinjuku-public", "toilet", "city_toilet", "新宿区", "新宿区公衆トイレ一覧", f"{CATALOGUE_PAGE}/t131041d0000000123", f"{CITY_FILES}/000399974.csv", "UTF-16LE",
        ("ID", "名称", "所在地_連結表記", "緯度", "経度", "車椅子使用者用トイレ有無"),
    ),
    Source(
        "tokyo-public-accessible", "toilet", "facility_toilet", "東京都福祉局", "公共施設等の車椅子使用者対応トイレ", f"{CATALOGUE_PAGE}/t000054d0000000342", f"{METRO_FILES}/fukushi/3_koukyoshisetsu_barieer_free_wc.csv", "Shift_JIS",
        ("管理者種別番号", "施設通し番号", "施設名", "市区町村・番地", "経度", "緯度", WIDE_DOOR),
    ),
    Source(
        "tokyo-station-accessible", "toilet", "station_toilet", "東京都福祉局", "鉄道駅の車椅子使用者対応トイレ", f"{CATALOGUE_PAGE}/t000054d0000000342", f"{METRO_FILES}/fukushi/R0606/02/4_tonaitetsudoueki_barrier-free-wc.csv", "Shift_JIS",
        ("管理者種別番号", "鉄道駅通し番号", "鉄道駅名", "市区町村・番地", "経度", "緯度", WIDE_DOOR),
    ),
)
GENRES = {"accommodation": "宿泊施設", "shopping": "ショッピング", "leisure": "レジャー", "dining": "飲食", "transport": "交通", "parks": "公園", "public_facilities": "公共施設"}
ACCESS_GUIDE = Source(
    "daredemo", "rest", "barrier_free", "東京都デジタルサービス局", "宿泊施設等の施設情報ポータルサイト「だれでも東京」", f"{CATALOGUE_PAGE}/t000029d0000000003", f"{METRO_FILES}/digitalservice/130001_Daredemo_Tokyo", "Shift_JIS",
    ("施設名", "市区町村名", "町丁目名"),
)
REST_POINTS = (
    Source(
        "tokyo-drinking-stations", "rest", "water", "東京都水道局", "Tokyowater Drinking Station 一覧", f"{CATALOGUE_PAGE}/t000019d0000000003", f"{METRO_FILES}/suidou/R7/tokyowaterdrinkingstation_250917.csv", "Shift_JIS",
        ("緯度", "経度", "施設名称", "所在地", "水飲み栓設置場所", "入場料等", "タイプ"), updated="2025-09-16",
    ),
    Source(
        "shinjuku-public-facilities", "rest", "city_facility", "新宿区", "新宿区の公共施設情報", f"{CATALOGUE_PAGE}/t131041d0000000113", f"{CITY_FILES}/000399965.csv", "UTF-16LE",
        ("ID", "名称", "所在地_連結表記", "緯度", "経度"), updated="2025-12-12",
    ),
    *[replace(ACCESS_GUIDE, key=f"daredemo-{genre}", name=f"{ACCESS_GUIDE.name}（{title}）", resource=f"{ACCESS_GUIDE.resource}_{genre}.csv", encoding="UTF-8" if genre == "accommodation" else "Shift_JIS") for genre, title in GENRES.items()],
)
SOURCES = TOILETS + REST_POINTS
