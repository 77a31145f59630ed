"""Stored tables and exchanged records, as explicit schemas."""

from pyspark.sql import types as T

# State and event names of the stored tables.
BOOK_STATES = ["pendiente", "publicado", "descartado", "vendido"]
BATCH_STATES = ["procesando", "revision", "publicado", "descartado"]
PUBLIC_EVENTS = ["vista", "busqueda", "clic_whatsapp", "scan_qr"]
INDEXED_STATES = ["pendiente", "publicado", "vendido"]
INVENTORY_STATES = ["publicado", "vendido"]

# Business limits.
MAX_PHOTOS = 10
CONFIDENCE_GATE = 0.7
GUARD_CONFIDENCE = 0.4
TOP_TERMS = 15
RECENT_EVENTS = 40
PAGE_SIZE = 15_000
DEFAULT_TEMPLATE = "Hola, vi en el catalogo que tenes {titulo} de {autor}. Sigue disponible?"
NO_AUTHOR = "Autor no disponible"
NO_TITLE = "(sin título)"
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp"]


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
}


def _struct(spec: str) -> T.StructType:
    """Like ``StructType.fromDDL``, which needs a running session and so cannot be used here."""
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# Layouts of the stored tables and of the exchanged records.
LIBRERIAS = _struct(
    "id BIGINT, slug STRING, nombre STRING, whatsapp STRING, mensaje_wa_template STRING, "
    "creado_en TIMESTAMP, activa BOOLEAN"
)
LOTES = _struct(
    "id BIGINT, libreria_id BIGINT, estado STRING, cant_fotos BIGINT, creado_en TIMESTAMP, "
    "publicado_en TIMESTAMP, archivado_en TIMESTAMP"
)
FOTOS = _struct("id BIGINT, lote_id BIGINT, path STRING, orden INT, creado_en TIMESTAMP")
LIBROS = _struct(
    "id BIGINT, libreria_id BIGINT, lote_id BIGINT, foto_id BIGINT, titulo_raw STRING, "
    "autor_raw STRING, titulo STRING, autor STRING, confianza DOUBLE, estado STRING, "
    "creado_en TIMESTAMP, publicado_en TIMESTAMP, vendido_en TIMESTAMP, duplicado_de BIGINT, "
    "archivado_en TIMESTAMP"
)
EVENTOS = _struct(
    "id BIGINT, libreria_id BIGINT, tipo STRING, payload STRING, session_id STRING, "
    "creado_en TIMESTAMP"
)
EVENTOS_RAW = _struct("slug STRING, tipo STRING, payload STRING, session_id STRING")
RESPUESTAS = _struct(
    "modelo STRING, lote_id BIGINT, foto_id BIGINT, texto STRING, costo DOUBLE, latencia_ms BIGINT"
)
EDITS = _struct("libro_id BIGINT, titulo STRING, autor STRING, estado STRING, ts TIMESTAMP")
VERDAD = T.MapType(
    T.StringType(),
    T.ArrayType(
        _struct("titulo STRING, autor STRING, autor_visible_en_foto BOOLEAN, nota STRING")
    ),
)

TABLES = {
    "librerias": LIBRERIAS,
    "lotes": LOTES,
    "fotos": FOTOS,
    "libros": LIBROS,
    "eventos": EVENTOS,
}
