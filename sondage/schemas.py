"""Schemas of manifests, samples, feature rows and events. Files are read with these and never inferred."""

MANIFEST = (
    "id string, rotulo string, tecnica string, gerador string, tipo_documento string, dificuldade string, "
    "documento_origem string, arquivo_gerado string, campo_alterado string, valor_original string, valor_substituto string, "
    "metodo_inpaint string, fonte string, parametros variant, parametros_captura variant, timestamp string"
)
#: Columns of a sample: a manifest without the names of its document.
SAMPLE = [
    "id", "rotulo", "tecnica", "gerador", "tipo_documento", "dificuldade", "campo_alterado", "metodo_inpaint",
    "fonte_tipografica", "fonte_dados", "documento_id", "arquivo", "parametros", "parametros_captura", "timestamp",
]
FEATURE = "key string, X array<float>, X_anomalia array<float>, y int, tecnica string, documento_origem string, tipo_documento string, gerador string, fonte string, caminho string"
EVENT = (
    "run_id string, ts double, tipo string, dispositivo string, epocas int, n_treino int, n_val int, epoca int, "
    "loss_treino double, loss_val double, auc_val double, auc_por_tecnica map<string,double>, n_amostras int, n_fraude int, "
    "n_legitimo int, por_tecnica map<string,bigint>, por_gerador map<string,bigint>, por_fonte map<string,bigint>, "
    "auc_fonte_sozinha double, equilibrado_por_origem boolean, auc_agrupada double, loto map<string,double>, "
    "logo map<string,double>, separabilidade_fonte double, recebido_em double"
)
BOX = "x int, y int, w int, h int, texto string"
