"""Table and column names of the published layout.

Operators use short English names. Dashboards written against the published layout read
the same tables under the names below; ``publish`` applies them.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearlog.functions.calendar import literal_map

CONTENT_TYPES = {
    "music": "musica",
    "podcast": "podcast",
    "audiobook": "audiolibro",
    "unknown": "desconocido",
}

# Column names shared by all tables.
COLUMNS = {
    "play_id": "id",
    "year": "año",
    "month": "mes",
    "day": "dia",
    "hour": "hora",
    "weekday": "dia_semana",
    "content_type": "tipo_arte",
    "country_name": "nombre_pais",
    "track_name": "master_metadata_track_name",
    "artist_name": "master_metadata_album_artist_name",
    "album_name": "master_metadata_album_album_name",
    "track_uri": "spotify_track_uri",
    "show_name": "episode_show_name",
    "episode_uri": "spotify_episode_uri",
    "chapter_uri": "audiobook_chapter_uri",
    "chapter_title": "audiobook_chapter_title",
    "time_id": "id_tiempo",
    "art_id": "id_arte",
    "location_id": "id_location",
    "user_id": "id_user",
    "playback_id": "id_reproduccion",
    "key_id": "id_clave",
    "plays": "reproducciones",
    "ms_total": "ms_total",
    "hours": "horas_total",
    "minutes": "minutos_total",
    "plays_pct": "pct_reproducciones",
    "skips": "saltadas",
    "skip_pct": "tasa_salto_pct",
    "complete_plays": "escuchas_completas",
    "weekday_name": "dia_nombre",
    "day_part": "franja",
    "mean_plays_per_day": "avg_reproducciones_dia",
    "active_days": "dias_activos",
    "mean_hours_per_month": "horas_promedio_mes",
    "active_months": "meses_activos",
    "monthly_price": "costo_mensual_mxn",
    "annual_price": "costo_anual_mxn",
    "monthly_price_x12": "costo_mensual_x12",
    "annual_saving": "ahorro_anual_mxn",
    "recommended_plan": "recomendacion_plan",
    "sessions": "total_sesiones",
    "mean_minutes": "duracion_media_min",
    "mean_plays": "tracks_media",
    "longest_minutes": "sesion_mas_larga_min",
    "origin": "origen",
    "origin_name": "origen_nombre",
    "complete_rate": "tasa_completa",
    "skip_rate": "tasa_skip",
    "mean_ms": "ms_promedio",
    "unique_tracks": "canciones_unicas",
    "repeat_ratio": "ratio_repeticion",
    "active_share": "pct_activa",
    "via_recommender": "via_algoritmo",
    "via_active": "via_activa",
    "recommender_share": "pct_algoritmo",
    "week": "año_semana",
    "profile": "nombre",
    "week_hours": "horas_semana",
    "unique_artists": "artistas_unicos",
    "diversity": "diversidad",
    "active_rate": "pct_activa",
    "music_rate": "pct_musica",
    "podcast_rate": "pct_podcast",
    "mean_hour": "hora_media",
    "weeks": "semanas_count",
    "position": "posicion_en_sesion",
    "minute_bucket": "bucket_min",
    "shuffle_on": "shuffle_enc",
    "mode": "modo",
    "active": "es_activa",
    "model": "modelo",
    "goal": "objetivo",
    "verdict": "interpretacion_analista",
    "best_k": "k_optimo",
    "weeks_analysed": "semanas_analizadas",
    "profiles": "perfiles",
    "skip_rate_shuffle_on": "tasa_skip_shuffle_on",
    "skip_rate_shuffle_off": "tasa_skip_shuffle_off",
    "skip_rate_active": "tasa_skip_activa",
    "skip_rate_recommender": "tasa_skip_algoritmo",
}

LISTENED = {"hours": "horas_escuchadas"}
TOTAL = {"plays": "total"}
RATES = {"plays": "total", "origin_name": "origen"}

# Table -> published name, and the columns named differently in that table.
TABLES = {
    "fact_plays": ("fact_streaming", {}),
    "dim_time": ("dim_tiempo", {}),
    "dim_art": ("dim_arte", {}),
    "dim_location": ("dim_pais", {}),
    "dim_user": ("dim_usuario", {}),
    "dim_playback": ("dim_reproduccion", {}),
    "dim_keys": ("dim_claves", {}),
    "time_per_year": ("G01_tiempo_total_por_año", {}),
    "content_mix": ("G02_distribucion_tipo_arte", {}),
    "skip_rate": ("G03_tasa_salto_global", TOTAL),
    "skip_rate_by_artist": ("G03_tasa_salto_por_artista", TOTAL),
    "complete_tracks": ("G04_canciones_completas_top50", {}),
    "activity_by_hour": ("G05_actividad_por_hora", LISTENED),
    "activity_by_month": ("G06_actividad_por_mes", LISTENED),
    "activity_by_weekday": ("G07_actividad_dia_semana", LISTENED),
    "top_artists": ("G08_artistas_top30", {}),
    "session_detail": (
        "G09_sesiones_detalle",
        {"plays": "tracks_en_sesion", "ms_total": "duracion_ms", "minutes": "duracion_min"},
    ),
    "session_stats": ("G09_sesiones_estadisticas", {}),
    "plan_recommendation": ("G10_plan_recomendacion", {}),
    "top_tracks_by_country": ("G11_top_tracks_por_pais", {}),
    "day_part_mix": ("G12_franja_horaria", LISTENED),
    "daily_average": ("G13_promedio_sesiones", {"plays": "total_reproducciones"}),
    "top_shows": ("G14_podcasts_top20", {"plays": "episodios_escuchados"}),
    "top_audiobooks": ("G15_audiolibros_top10", {"plays": "sesiones"}),
    "origin_comparison": ("ML1_comparativa_origen", TOTAL | {"hours": "horas_totales"}),
    "origin_diversity": (
        "ML1_diversidad_por_origen", {"origin_name": "origen", "plays": "total_repros"}
    ),
    "origin_trend": ("ML1_tendencia_temporal", TOTAL),
    "origin_artists": ("ML1_artistas_por_origen", TOTAL),
    "origin_importance": ("ML1_feature_importance", {}),
    "origin_result": (
        "ML1_resultados",
        {
            "active_share": "pct_global_activa",
            "recommender_share": "pct_global_algoritmo",
            "plays": "total_reproducciones",
        },
    ),
    "week_profiles": ("ML2_semanas_con_cluster", {}),
    "week_centres": ("ML2_perfil_clusters", {}),
    "week_silhouette": ("ML2_silhouette_scores", {}),
    "week_profiles_by_year": ("ML2_distribucion_por_año", {}),
    "week_profiles_by_month": ("ML2_distribucion_por_mes", {}),
    "week_result": ("ML2_resultados", {}),
    "skip_importance": ("ML3_feature_importance", {}),
    "skip_by_position": ("ML3_skip_por_posicion", RATES),
    "skip_by_minutes": ("ML3_skip_por_minutos", RATES),
    "skip_by_hour": ("ML3_skip_por_hora", RATES),
    "skip_by_shuffle": ("ML3_skip_shuffle_vs_orden", RATES),
    "skip_by_origin": ("ML3_skip_activa_vs_algoritmo", RATES),
    "skip_result": ("ML3_resultados", {"skip_rate": "tasa_skip_global"}),
}

# Feature names appear as values in the model tables.
FEATURE_NAMES = {
    "complete": "escucha_completa",
    "skip": "skip_int",
    "hour": "hora",
    "weekday": "dia_semana",
    "shuffle_on": "shuffle_enc",
    "position": "posicion_en_sesion",
    "minutes_before": "min_acumulado_sesion",
    "skips_before": "skips_previos",
    "active": "es_activa",
    "month": "mes",
}


def published_name(table: str) -> str:
    return TABLES[table][0] if table in TABLES else table


def publish(table: str, df: DataFrame) -> DataFrame:
    """A library table under its published column names and values."""
    own = TABLES[table][1] if table in TABLES else {}
    if "content_type" in df.columns:
        kind = F.try_element_at(literal_map(CONTENT_TYPES), F.col("content_type"))
        df = df.withColumn("content_type", F.coalesce(kind, F.col("content_type")))
    features = literal_map(FEATURE_NAMES)

    def feature_name(name):
        return F.coalesce(F.try_element_at(features, name), name)

    for column in ("feature", "top_feature"):
        if column in df.columns:
            df = df.withColumn(column, feature_name(F.col(column)))
    if "feature_names" in df.columns:
        df = df.withColumn("feature_names", F.transform("feature_names", feature_name))
    if "profiles" in df.columns:
        fields = df.schema["profiles"].dataType.elementType.fieldNames()
        df = df.withColumn(
            "profiles",
            F.transform(
                "profiles",
                lambda p: F.struct(*[p[f].alias(COLUMNS.get(f, f)) for f in fields]),
            ),
        )
    return df.select(*[F.col(c).alias(own.get(c, COLUMNS.get(c, c))) for c in df.columns])
