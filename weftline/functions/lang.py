"""English or not, by character trigrams under naive Bayes.

``PROFILES`` are short passages of plain prose of our own; ``fit_profiles`` makes profiles from a labelled table.
The text's first ``head`` characters are judged, as the crawler's gate has it; null or letterless is not English.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROFILES = {
    "en": "hello world! the quick answer is that people who have read this page will know what they should do when there is nothing else to be found in the other one. we were going to see them with their friends and it was not easy for him or her to say which of these things could have been made by those who work here every day. how are you today my friend, thank you very much, please come back again",
    "fr": "bonjour le monde, les gens qui ont lu cette page savent ce qu'il faut faire quand il n'y a rien d'autre dans les autres. nous allions voir avec nos amis et ce n'était pas facile pour lui ou pour elle de dire laquelle de ces choses avait été faite par ceux qui travaillent ici tous les jours. deviner une énigme est un jeu, une fois encore, merci beaucoup et à bientôt, comment allez-vous aujourd'hui",
    "de": "hallo welt, die leute die diese seite gelesen haben wissen was sie tun sollen wenn es in den anderen nichts mehr zu finden gibt. wir wollten sie mit ihren freunden sehen und es war nicht leicht für ihn oder für sie zu sagen welche von diesen dingen von denen gemacht wurden die hier jeden tag arbeiten. wie geht es ihnen heute, vielen dank und auf wiedersehen, schöne grüße",
    "es": "hola mundo, la gente que ha leído esta página sabe lo que debe hacer cuando no hay nada más en las otras. íbamos a ver con nuestros amigos y no fue fácil para él o para ella decir cuál de estas cosas había sido hecha por los que trabajan aquí todos los días. cómo está usted hoy, muchas gracias y hasta luego, adivinar un enigma es un juego",
    "it": "ciao mondo, la gente che ha letto questa pagina sa che cosa deve fare quando non c'è più niente nelle altre. andavamo a vedere con i nostri amici e non era facile per lui o per lei dire quale di queste cose fosse stata fatta da quelli che lavorano qui ogni giorno. come sta oggi, grazie mille e arrivederci, indovinare un enigma è un gioco",
    "pt": "olá mundo, as pessoas que leram esta página sabem o que devem fazer quando não há mais nada nas outras. íamos ver com os nossos amigos e não foi fácil para ele ou para ela dizer qual destas coisas tinha sido feita pelos que trabalham aqui todos os dias. como está hoje, muito obrigado e até logo, adivinhar um enigma é um jogo",
    "nl": "hallo wereld, de mensen die deze bladzijde gelezen hebben weten wat zij moeten doen wanneer er in de andere niets meer te vinden is. wij gingen hen met hun vrienden zien en het was niet gemakkelijk voor hem of voor haar om te zeggen welke van deze dingen gemaakt waren door degenen die hier elke dag werken. hoe gaat het met u vandaag, dank u wel en tot ziens",
}


def trigrams(text: str) -> Counter:
    words = "".join(c if c.isalpha() or c == "'" else " " for c in text.lower()).split()
    return Counter(w[i : i + 3] for w in (f" {w} " for w in words) for i in range(len(w) - 2))


def fit_profiles(rows: DataFrame, per_lang: int = 2000) -> dict[str, Counter]:
    """Trigram counts by language of (lang, text), from a sample of about ``per_lang`` rows each."""
    n = {r["lang"]: r["n"] for r in rows.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    out: dict[str, Counter] = {k: Counter() for k in n}
    for r in rows.where("text IS NOT NULL").sampleBy("lang", {k: min(1.0, per_lang / v) for k, v in n.items()}, 1).toLocalIterator():
        out[r["lang"]].update(trigrams(r["text"]))
    return out


def probabilities(text: str, profiles: dict[str, Counter]) -> dict[str, float]:
    seen = trigrams(text)
    if not seen:
        return {}
    names = {g for p in profiles.values() for g in p}
    logs = {}
    for lang, p in profiles.items():
        total = sum(p.values()) + 0.5 * (len(names) + 1)
        logs[lang] = sum(c * math.log((p[g] + 0.5) / total) for g, c in seen.items())
    top = max(logs.values())
    z = sum(math.exp(v - top) for v in logs.values())
    return {k: math.exp(v - top) / z for k, v in logs.items()}


def is_english(text: Column, profiles: dict[str, Counter] | None = None, head: int = 1000, least: float = 0.75) -> Column:
    """Whether the most probable language is ``en`` with a probability above ``least``."""
    known = profiles or {k: trigrams(v) for k, v in PROFILES.items()}
    names = {g for p in known.values() for g in p}
    weights = {}
    for lang, p in known.items():
        total = sum(p.values()) + 0.5 * (len(names) + 1)
        weights[lang] = ({g: math.log((c + 0.5) / total) for g, c in p.items()}, math.log(0.5 / total))

    @F.pandas_udf("boolean")
    def judge(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            seen = trigrams(t) if t else None
            if not seen:
                out.append(False)
                continue
            logs = {k: sum(c * w.get(g, none) for g, c in seen.items()) for k, (w, none) in weights.items()}
            top = max(logs.values())
            p = {k: math.exp(v - top) for k, v in logs.items()}
            out.append(p.get("en", 0.0) / sum(p.values()) > least)
        return pd.Series(out, dtype=bool)

    return judge(F.substring(text, 1, head))
