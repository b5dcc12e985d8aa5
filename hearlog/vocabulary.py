"""Lookup tables, labels and texts that appear in results."""

COUNTRY_NAMES = {
    "MX": "México",
    "US": "Estados Unidos",
    "ES": "España",
    "CO": "Colombia",
    "AR": "Argentina",
    "BR": "Brasil",
    "CL": "Chile",
    "PE": "Perú",
    "VE": "Venezuela",
    "EC": "Ecuador",
    "GT": "Guatemala",
    "CU": "Cuba",
    "BO": "Bolivia",
    "DO": "República Dominicana",
    "HN": "Honduras",
    "PY": "Paraguay",
    "SV": "El Salvador",
    "NI": "Nicaragua",
    "CR": "Costa Rica",
    "PA": "Panamá",
    "UY": "Uruguay",
    "DE": "Alemania",
    "FR": "Francia",
    "GB": "Reino Unido",
    "IT": "Italia",
    "JP": "Japón",
    "KR": "Corea del Sur",
    "CA": "Canadá",
    "AU": "Australia",
}
UNKNOWN_COUNTRY = "Desconocido"

WEEKDAY_NAMES = {
    1: "Domingo",
    2: "Lunes",
    3: "Martes",
    4: "Miércoles",
    5: "Jueves",
    6: "Viernes",
    7: "Sábado",
}

MONTH_LABELS = {
    1: "Ene",
    2: "Feb",
    3: "Mar",
    4: "Abr",
    5: "May",
    6: "Jun",
    7: "Jul",
    8: "Ago",
    9: "Sep",
    10: "Oct",
    11: "Nov",
    12: "Dic",
}

# First hour of each part of the day; everything else, a missing hour too, is night.
DAY_PARTS = [(0, "Madrugada (0-5h)"), (6, "Mañana (6-11h)"), (12, "Tarde (12-17h)")]
NIGHT_FROM = 18
NIGHT = "Noche (18-23h)"

ACTIVE_REASONS = ["clickrow", "playbtn", "remote", "backbtn"]
RECOMMENDER_REASONS = ["trackdone", "autoplay", "fwdbtn"]
ORIGIN_NAMES = {0: "Algoritmo (Spotify)", 1: "Elección Activa (Tú)"}
ORIGIN_NAMES_SHORT = {1: "Elección Activa", 0: "Algoritmo (Spotify)"}
SHUFFLE_NAMES = {0: "Orden fijo", 1: "Shuffle"}

PLAN_ANNUAL = "anual"
PLAN_MONTHLY = "mensual"
PLAN_LABELS = ["12 × Mensual", "Plan Anual"]

ORIGIN_MODEL = "Random Forest — Algoritmo vs Elección Activa"
ORIGIN_VERDICTS = {
    "alike": (
        "El modelo no puede distinguir bien entre lo que elegiste tú "
        "y lo que puso el algoritmo → escuchas ambos de forma similar. "
        "El algoritmo te conoce bien."
    ),
    "own_picks": (
        "Escuchas más completo lo que elegiste tú. "
        "El algoritmo te pone canciones que no terminás. "
        "Considera usar más playlists propias y menos radio."
    ),
    "context": (
        "El algoritmo acierta en términos de completitud, "
        "pero hay diferencias en el contexto de skip. "
        "Revisá los patrones por hora."
    ),
}
ALIKE_BELOW_ACCURACY = 0.58
OWN_PICKS_ABOVE_GAP = 0.05

WEEK_MODEL = "K-Means — Perfil de Oyente Semanal"
WEEK_VERDICT = (
    "Se identificaron %d perfiles de semana de escucha. "
    "Revisá en qué épocas del año dominan los perfiles exploratorios "
    "vs los de loop para entender tus ciclos de descubrimiento musical."
)
PODCAST_WEEK_ABOVE = 0.3
WEEK_PROFILES = {
    "podcasts": "🎙️ Semana de Podcasts",
    "explorer_marathon": "🔭 Maratón Exploratorio",
    "loop_marathon": "🔁 Maratón en Loop",
    "exploration": "🆕 Exploración Musical",
    "skipping": "⏭️ Modo Shuffle Activo",
    "quiet": "🔇 Semana de Poco Uso",
    "passive": "🤖 Semana Pasiva (Algoritmo)",
    "regular": "🎧 Escucha Regular",
}

SKIP_MODEL = "Gradient Boosting — Fatiga y Contexto de Skip"
SKIP_GOAL = "Predecir skip usando contexto de sesión"
SKIP_VERDICTS = {
    "position": "Tus sesiones son demasiado largas — el skip aumenta a medida que avanza la sesión. Considerá playlists más cortas.",
    "minutes_before": "La fatiga temporal es el principal driver del skip — definí un tiempo máximo de escucha continua.",
    "skips_before": "El skip en cadena es tu patrón dominante — cuando empezás a saltear, no parás. El problema suele ser la playlist entera, no una canción.",
    "hour": "La hora del día determina más que nada si vas a saltear. Hay franjas en que la escucha no conecta contigo.",
    "shuffle_on": "El modo shuffle es el principal predictor de skip — las canciones aleatorias no se adaptan a tu estado de ánimo actual.",
    "active": "Saltás más lo que el algoritmo pone vs lo que vos elegís — considerá usar más playlists propias.",
    "weekday": "El día de la semana domina el skip — hay días en que simplemente no querés escuchar.",
    "month": "La época del año afecta tu tolerancia — hay meses con mayor rechazo musical.",
}
SKIP_VERDICT_OTHER = "El factor más influyente es '%s'."

FEATURE_LABELS = {
    "position": "Posición en sesión",
    "minutes_before": "Minutos acumulados",
    "skips_before": "Skips previos en sesión",
    "hour": "Hora del día",
    "weekday": "Día de la semana",
    "shuffle_on": "Shuffle activo",
    "active": "Elección activa (no algoritmo)",
    "month": "Mes del año",
}
ACTUAL_LABELS = {0: "Real: No Skip", 1: "Real: Skip"}
PREDICTED_LABELS = {0: "Pred: No Skip", 1: "Pred: Skip"}
