"""Texts of the activity notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Openings of a notification.
INTERJECTIONS = [
    "Bravo ", "Super", "Bien joué", "Magnifique", "Quel effort", "Belle perf",
    "Impressionnant", "Ça rigole pas", "Chapeau",
]

# Per sport the phrases, cheers and emojis. Keys are data values, kept as they
# arrive. {duree_formate} and {distance_km} are filled in.
SPORT_TEXTS = {
    "Tennis": (
        [
            "tu viens de jouer au tennis pendant {duree_formate} ",
            "match de tennis terminé en {duree_formate} ",
            "session de tennis bouclée en {duree_formate} ",
        ],
        ["Quelle énergie", "Belle intensité", "Continue comme ça", "Ça envoie du lourd"],
        ["🎾", "🔥", "💪"],
    ),
    "Badminton": (
        [
            "tu viens de taper le volant pendant {duree_formate} ",
            "session de badminton terminée en {duree_formate} ",
            "match de badminton bouclé en {duree_formate} ",
        ],
        ["Quel rythme", "Super vivacité", "Beau jeu", "Ça fuse"],
        ["🏸", "⚡", "🔥"],
    ),
    "Escalade": (
        [
            "session d’escalade terminée en {duree_formate} ",
            "tu viens de grimper pendant {duree_formate} ",
            "enchaînement de voies en {duree_formate} ",
        ],
        ["Belle maîtrise", "Quel mental", "Force et technique", "Bien accroché"],
        ["🧗‍♂️", "💪", "🔥"],
    ),
    "Randonnée": (
        [
            "randonnée de {distance_km} km terminée en {duree_formate} ",
            "tu viens de parcourir {distance_km} km en randonnée ",
            "{distance_km} km de marche bouclés en {duree_formate} ",
        ],
        [
            "Quelle aventure",
            "De beaux paysages à la clé",
            "Encore une belle exploration",
            "La nature te réussit",
        ],
        ["🌄", "🥾", "🏕️"],
    ),
    "Triathlon": (
        [
            "séance de triathlon complétée en {duree_formate} ",
            "enchaînement natation, vélo et course terminé ",
            "gros effort de triathlon sur {duree_formate} ",
        ],
        ["Quel défi", "Performance impressionnante", "Endurance au top", "Respect"],
        ["🏊‍♂️", "🚴‍♂️", "🏃‍♂️"],
    ),
    "Runing": (
        [
            "tu viens de courir {distance_km} km en {duree_formate} ",
            "{distance_km} km avalés en {duree_formate} ",
            "sortie running de {distance_km} km terminée ",
        ],
        ["Quelle foulée", "Tu es en feu", "Ça déroule", "Belle perf"],
        ["🏃‍♂️", "🔥", "🏅"],
    ),
    "Équitation": (
        [
            "séance d’équitation de {duree_formate} terminée ",
            "moment à cheval pendant {duree_formate} ",
            "travail équestre complété en {duree_formate} ",
        ],
        ["Belle complicité", "Quel équilibre", "Harmonie parfaite", "Super connexion"],
        ["🐎", "✨", "💫"],
    ),
    "Voile": (
        [
            "sortie voile de {duree_formate} terminée ",
            "navigation complétée en {duree_formate} ",
            "session en mer de {duree_formate} ",
        ],
        ["Bon vent", "Belle maîtrise", "Cap parfaitement tenu", "Ça glisse"],
        ["⛵", "🌊", "💨"],
    ),
    "Tennis de table": (
        [
            "match de ping terminé en {duree_formate} ",
            "session de tennis de table bouclée ",
            "échanges rapides pendant {duree_formate} ",
        ],
        ["Quel réflexe", "Ça va très vite", "Beau toucher", "Top spin assuré"],
        ["🏓", "⚡", "🔥"],
    ),
    "Football": (
        [
            "match de foot joué pendant {duree_formate} ",
            "session football terminée ",
            "tu viens de fouler le terrain pendant {duree_formate} ",
        ],
        ["Quel collectif", "Belle intensité", "Ça joue bien", "Match solide"],
        ["⚽", "🔥", "💪"],
    ),
    "Natation": (
        [
            "séance de natation de {duree_formate} terminée",
            "longueurs enchaînées pendant {duree_formate} ",
            "session piscine complétée",
        ],
        ["Belle glisse", "Respiration maîtrisée", "Ça coule tout seul", "Super endurance"],
        ["🏊‍♂️", "💦", "🔥"],
    ),
    "Judo": (
        [
            "entraînement de judo de {duree_formate} terminé",
            "séance sur le tatami complétée ",
            "combat et technique pendant {duree_formate} ",
        ],
        ["Quel mental", "Force et respect", "Belle maîtrise", "Esprit du judo"],
        ["🥋", "💪", "🔥"],
    ),
    "Basketball": (
        [
            "match de basket joué pendant {duree_formate} ",
            "session basketball terminée",
            "enchaînement de paniers pendant {duree_formate} ",
        ],
        ["Belle adresse", "Ça score", "Quel rythme", "Jeu fluide"],
        ["🏀", "🔥", "💪"],
    ),
    "Rugby": (
        [
            "match de rugby disputé pendant {duree_formate} ",
            "session rugby complétée",
            "gros combat sur le terrain pendant {duree_formate} ",
        ],
        ["Quel engagement", "Solide et collectif", "Respect", "Ça plaque fort"],
        ["🏉", "💪", "🔥"],
    ),
    "Boxe": (
        [
            "séance de boxe de {duree_formate} terminée",
            "enchaînements de coups pendant {duree_formate} ",
            "entraînement boxing complété",
        ],
        ["Quel cardio", "Belle explosivité", "Ça cogne fort", "Mental d’acier"],
        ["🥊", "🔥", "💪"],
    ),
}

SCHEMA = "sport_type string, phrases array<string>, cheers array<string>, emojis array<string>"


def templates(spark: SparkSession) -> DataFrame:
    """One row per sport. A fixed, tiny dimension."""
    return spark.createDataFrame([(s, *texts) for s, texts in SPORT_TEXTS.items()], SCHEMA)
