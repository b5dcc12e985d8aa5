"""Tables under the names of the published layout: their columns, and rows from the events."""

from pyspark.sql import functions as F

from contract.marts import G04, G08, G11, detail_cte
from contract.refine import FACT_CTE, fact
from contract.tables import history, on_history, on_raw
from hearlog.operators import refine
from hearlog.params import Params
from hearlog.plans.layers import FACT, build_marts
from hearlog.plans.published import publish, published_name


def _listed(tables):
    """Published name, columns and number of rows of each table."""
    rows = None
    for name, df in tables:
        shown = publish(name, df)
        row = shown.agg(F.count("*").alias("table_rows")).select(
            F.lit(published_name(name)).alias("table_name"), F.lit(",".join(shown.columns)).alias("columns"), "table_rows"
        )
        rows = row if rows is None else rows.union(row)
    return rows


def published_marts(spark, sf):
    cubes = ("calendar_cube", "catalogue_cube")
    return _listed((n, df) for n, df in build_marts(history(spark, sf), Params()).items() if n not in cubes)


def published_plays(spark, sf):
    plays = fact(spark, sf)
    return _listed([(FACT, plays.drop("listener_id")), *((n, extract(plays)) for n, extract in refine.DIMENSIONS.items())])


QUERIES = {"p_published_marts": published_marts, "p_published_plays": published_plays}

# Name, columns and how to count the rows of each published mart.
MARTS = [
    ("G01_tiempo_total_por_año", "año,reproducciones,ms_total,horas_total", "SELECT DISTINCT year FROM history"),
    ("G02_distribucion_tipo_arte", "tipo_arte,reproducciones,ms_total,horas_total,pct_reproducciones", "SELECT DISTINCT content_type FROM history"),
    ("G03_tasa_salto_global", "saltadas,total,tasa_salto_pct", "SELECT 1"),
    ("G03_tasa_salto_por_artista", "master_metadata_album_artist_name,saltadas,total,tasa_salto_pct",
     "SELECT artist_name FROM history WHERE content_type = 'music' GROUP BY 1 HAVING count(*) >= 5"),
    ("G04_canciones_completas_top50", "master_metadata_track_name,master_metadata_album_artist_name,master_metadata_album_album_name,"
     "escuchas_completas,ms_total,minutos_total", G04),
    ("G05_actividad_por_hora", "hora,reproducciones,ms_total,horas_escuchadas", "SELECT DISTINCT hour FROM history"),
    ("G06_actividad_por_mes", "año,mes,reproducciones,ms_total,horas_escuchadas", "SELECT DISTINCT year, month FROM history"),
    ("G07_actividad_dia_semana", "dia_semana,reproducciones,ms_total,horas_escuchadas,dia_nombre", "SELECT DISTINCT weekday FROM history"),
    ("G08_artistas_top30", "master_metadata_album_artist_name,reproducciones,escuchas_completas,ms_total,horas_total", G08),
    ("G09_sesiones_detalle", "session_id,tracks_en_sesion,duracion_ms,duracion_min", "SELECT * FROM detail"),
    ("G09_sesiones_estadisticas", "total_sesiones,duracion_media_min,tracks_media,sesion_mas_larga_min", "SELECT 1"),
    ("G10_plan_recomendacion", "horas_promedio_mes,meses_activos,costo_mensual_mxn,costo_anual_mxn,costo_mensual_x12,ahorro_anual_mxn,"
     "recomendacion_plan", "SELECT 1"),
    ("G11_top_tracks_por_pais", "conn_country,nombre_pais,master_metadata_track_name,master_metadata_album_artist_name,reproducciones,rank",
     "SELECT * FROM by_country"),
    ("G12_franja_horaria", "franja,tipo_arte,reproducciones,ms_total,horas_escuchadas",
     "SELECT DISTINCT hour // 6, content_type FROM history"),
    ("G13_promedio_sesiones", "avg_reproducciones_dia,total_reproducciones,dias_activos", "SELECT 1"),
    ("G14_podcasts_top20", "episode_show_name,episodios_escuchados,ms_total,horas_total",
     "SELECT DISTINCT show_name FROM history WHERE content_type = 'podcast' LIMIT 20"),
    ("G15_audiolibros_top10", "audiobook_title,sesiones,ms_total,horas_total",
     "SELECT DISTINCT audiobook_title FROM history WHERE content_type = 'audiobook' LIMIT 10"),
]


def _listing(tables) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{columns}' AS columns, count(*) AS table_rows FROM ({body})" for name, columns, body in tables
    )


PLAYS = [
    ("fact_streaming", "ts,platform,ms_played,conn_country,ip_addr,master_metadata_track_name,master_metadata_album_artist_name,"
     "master_metadata_album_album_name,spotify_track_uri,episode_name,episode_show_name,spotify_episode_uri,audiobook_title,"
     "audiobook_uri,audiobook_chapter_uri,audiobook_chapter_title,reason_start,reason_end,shuffle,skipped,offline,"
     "offline_timestamp,incognito_mode,id,start_ms,año,mes,dia,hora,dia_semana,tipo_arte,nombre_pais", "SELECT * FROM fact"),
    ("dim_tiempo", "id_tiempo,año,mes,dia,hora,dia_semana", "SELECT DISTINCT year, month, day, hour FROM fact"),
    ("dim_arte", "id_arte,master_metadata_track_name,master_metadata_album_artist_name,master_metadata_album_album_name,episode_name,"
     "episode_show_name,audiobook_title,audiobook_chapter_title,tipo_arte", "SELECT * FROM fact"),
    ("dim_pais", "id_location,conn_country,nombre_pais", "SELECT * FROM fact"),
    ("dim_usuario", "id_user,ip_addr,platform", "SELECT * FROM fact"),
    ("dim_reproduccion", "id_reproduccion,ms_played,reason_end,reason_start,skipped,shuffle,offline,incognito_mode", "SELECT * FROM fact"),
    ("dim_claves", "id_clave,audiobook_chapter_uri,audiobook_uri,spotify_episode_uri,spotify_track_uri", "SELECT * FROM fact"),
]

ORACLES = {"p_published_marts": on_history(_listing(MARTS), G11 + "," + detail_cte()),
           "p_published_plays": on_raw(_listing(PLAYS), FACT_CTE)}
