"""The texts that codes are shown with; with_labels() joins any of them to a column of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes and their texts.
CATEGORIES = {
    "public_outdoor_space": "公園・屋外公共空間",
    "public_service_facility": "一般利用目的が明確な公共施設",
    "official_public_access": "公式掲載施設（公開条件は要確認）",
    "commercial_facility": "商業施設",
    "private_hospitality": "ホテル等の民間施設",
    "restricted_or_sensitive": "学校・福祉等の慎重な取扱いが必要な施設",
    "uncertain_facility": "利用目的が不明な公式掲載施設",
}
CATEGORY_REASONS = {
    "OFFICIAL_PARK_DATASET": "公式データで公園・屋外公共空間として掲載",
    "PUBLIC_SERVICE_NAME": "名称から区役所・出張所・観光案内等の一般利用目的を確認できる",
    "OFFICIAL_PUBLIC_FACILITY_DATASET": "公共施設として公式掲載されているが、自由利用条件は未確認",
    "OFFICIAL_BARRIER_FREE_LISTING": "バリアフリー施設情報への掲載であり、休憩利用の可否は未確認",
    "COMMERCIAL_DATASET": "商業・飲食・レジャー施設として公式掲載",
    "PRIVATE_HOSPITALITY_DATASET": "宿泊施設として公式掲載されている民間施設",
    "RESTRICTED_OR_SENSITIVE_NAME": "学校・保育・福祉等を示す名称のため、一般向け現地調査先から除外",
    "UNKNOWN_ACCESS_PURPOSE": "公式掲載はあるが、一般利用目的をデータから確認できない",
}
SELECTION_REASONS = {
    "POSITIVE_DETOUR_ADJUSTED_IMPROVEMENT": "施設からルートまでの推定直線下限を差し引いても休憩空白の改善が残る",
    "MARGINAL_DETOUR_ADJUSTED_IMPROVEMENT": "迂回調整後の改善は30〜49mで、効果が限定的か現地で確認する必要がある",
    "CLOSE_TO_DYNAMIC_ROUTE_50M": "代表動的経路から推定直線50m以内",
    "CLOSE_TO_DYNAMIC_ROUTE_100M": "代表動的経路から推定直線100m以内",
    "MULTIPLE_DYNAMIC_ROUTES": "複数の代表動的経路で迂回調整後の改善に寄与",
    "PUBLIC_OUTDOOR_PRIORITY": "公園・屋外公共空間を優先",
    "PUBLIC_SERVICE_PRIORITY": "一般利用目的が明確な公共施設を優先",
    "HIGH_OFFICIAL_SOURCE_QUALITY": "自治体等の構造化された公式情報を根拠にする",
    "DEDUPLICATED_FACILITY": "同一施設と考えられる複数レコードを1地点として評価",
    "NO_EXISTING_STRICT_DUPLICATE": "既存のconfirmed / supported地点とは重複しない",
    "PRIVATE_ACCESS_CONFIRMATION_NEEDED": "民間施設のため一般利用条件の確認が必要",
    "COMMERCIAL_ACCESS_CONFIRMATION_NEEDED": "商業施設の営業時間・利用条件の確認が必要",
}
EXCLUSION_REASONS = {
    "COORDINATE_SOURCE_ANOMALY": "異なる施設が同一座標へ集中する上流品質異常",
    "EXISTING_STRICT_REST_DUPLICATE": "既存のconfirmed / supported地点と同一施設候補",
    "RESTRICTED_OR_SENSITIVE_FACILITY": "学校・福祉等の慎重な取扱いが必要な施設",
    "NO_DYNAMIC_ROUTE_WITHIN_DISTANCE": "代表動的3経路から推定直線350m以内にない",
    "NO_GROSS_GAP_IMPROVEMENT": "代表動的経路で迂回を含まない理論改善が0m",
    "DETOUR_ADJUSTED_IMPROVEMENT_BELOW_THRESHOLD": "迂回調整後の改善が30mまたは2.5%の基準に届かない",
}
CATEGORY_CAUTIONS = {
    "private_hospitality": "宿泊・飲食利用なしでの入館、着席、営業時間内の一般利用条件を確認する。ホテル掲載を休憩可能の根拠にしない。",
    "commercial_facility": "営業時間、購入を伴わない滞在の可否、座席の利用条件を確認する。",
    "official_public_access": "公式掲載は自由な入館・着席を意味しないため、利用目的、開館時間、入館条件を確認する。",
    "uncertain_facility": "公式掲載は自由な入館・着席を意味しないため、利用目的、開館時間、入館条件を確認する。",
    "public_service_facility": "窓口・開館時間、来訪目的がない場合の入館、休憩スペースの利用条件を確認する。",
    "public_outdoor_space": "利用時間、工事・閉鎖、座席、日陰や雨よけの有無を確認する。",
    "restricted_or_sensitive": "一般利用の可否と現地の利用条件を確認する。",
}


def table(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """code and text, a row for each code."""
    return spark.createDataFrame(list(texts.items()), "code string, text string")


def labelled(code: Column, texts: dict[str, str]) -> Column:
    """The text of each code; a code without one is its own text."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), code), code)
