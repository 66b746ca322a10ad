"""Display names and reason formats of the fourteen methods."""

from __future__ import annotations

# The names shown in reports.
NAMES = {
    "zscore": "Z-Score",
    "iqr": "IQR (Tukey)",
    "mad": "Modified Z-Score (MAD)",
    "mahalanobis": "Distância de Mahalanobis",
    "knn": "KNN Distance",
    "lof": "LOF",
    "isolation_forest": "Isolation Forest",
    "percentile_fence": "Percentile Fence",
    "frequency": "Frequência Relativa",
    "entropy": "Entropia por Linha",
    "chi_square": "Qui-Quadrado",
    "binomial": "Teste Binomial",
    "cooccurrence": "Co-ocorrência de Pares",
    "lof_categorical": "LOF Categórico",
}
RANDOM_BASELINE = ("aleatorio", "Aleatório (linha de base)", "—")

# The text of a reason, in printf form.
REASONS = {
    "zscore": "'%s' = %s está a %+.2f desvios-padrão da média (limiar ±%.2f)",
    "iqr": "'%s' = %s fora do intervalo [%s; %s] (m = %.2f)",
    "mad": "'%s' = %s tem Z modificado %+.2f (mediana %s, limiar ±%s)",
    "mahalanobis": "D² = %.2f > %.2f; '%s' = %s responde por %.0f%% da distância",
    "knn": "distância média %.2f aos %d vizinhos; ",
    "lof": "LOF = %.2f (densidade %.1f× menor que a dos vizinhos); ",
    "isolation_forest": "isolado com profundidade média baixa (score %.3f); ",
    "largest_deviation": "maior desvio em '%s' = %s (%+.2f desvios-padrão)",
    "percentile_fence": "'%s' = %s fora dos percentis [%.2f%%; %.2f%%] = [%s; %s]",
    "frequency": "'%s' = '%s' aparece em só %.2f%% das linhas",
    "entropy": "surpresa média %.2f× a entropia das colunas; maior em '%s' = '%s' (%.1f bits)",
    "chi_square_one": "'%s' = '%s' bem abaixo da frequência esperada (resíduo %.2f)",
    "chi_square": "combinação '%s' = '%s' com '%s' = '%s' ocorre muito menos que o esperado (resíduo de Pearson %.2f)",
    "binomial": "'%s' = '%s' é rara demais para o acaso (p = %s < %s)",
    "cooccurrence": "par '%s' = '%s' e '%s' = '%s' aparece em só %.2f%% das linhas",
    "lof_categorical": "combinação de categorias isolada (LOF %.2f); valor mais raro: '%s' = '%s' (%.2f%%)",
}

# What each method looks for, in our own words.
DESCRIPTIONS = {
    "zscore": "Largest number of standard deviations from a column mean.",
    "iqr": "Distance outside the quartile box, in box heights.",
    "mad": "Distance from the median in median absolute deviations.",
    "mahalanobis": "Squared distance from the centre under the covariance of all columns.",
    "knn": "Mean distance to the nearest rows.",
    "lof": "Local density of the neighbours relative to the row's own.",
    "isolation_forest": "How few random cuts separate the row from a small sample.",
    "percentile_fence": "Values beyond the outer percentiles of a column.",
    "frequency": "Share of the rarest value of the row.",
    "entropy": "Mean surprise of the row's values relative to column entropy.",
    "chi_square": "Pairs of values that occur far less than independence predicts.",
    "binomial": "Values too rare to be chance under a binomial law.",
    "cooccurrence": "Mean surprise of the row's value pairs.",
    "lof_categorical": "Local outlier factor on mismatch counts between rows.",
}
