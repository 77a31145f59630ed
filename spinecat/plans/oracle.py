"""DuckDB statements that must give the same rows as the queries of ``registry.py``."""

from __future__ import annotations

from spinecat.functions import text
from spinecat.plans.oracle_views import (
    TEMPLATE,
    VIEWS,
    key,
    main_title,
    member,
    normal,
    nothing,
    search_form,
    slug,
    with_views,
)

STATEMENTS: dict[str, str] = {}


def define(name: str, views: list[str], body: str, recursive: bool = False) -> None:
    STATEMENTS[name] = with_views(views, body, recursive)


def stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


PUBLIC = "estado = 'publicado' AND archivado_en IS NULL"
INVENTORY = "estado IN ('publicado', 'vendido') AND archivado_en IS NULL"

define(
    "shop_book_counts",
    ["librerias", "libros"],
    f"""SELECT l.id AS libreria_id, l.slug, l.nombre, {stamp('l.creado_en')} AS creado_en,
    (SELECT count(*) FROM libros b WHERE b.libreria_id = l.id AND {PUBLIC}) AS cant_libros,
    row_number() OVER (ORDER BY l.creado_en DESC, l.id) AS puesto
    FROM librerias l WHERE l.activa""",
)
define(
    "published_counts",
    ["libros"],
    f"SELECT libreria_id, count(*) AS cant_libros FROM libros WHERE {PUBLIC} GROUP BY ALL",
)
define(
    "review_queue",
    ["lotes", "libros"],
    f"""SELECT l.id, l.libreria_id, l.cant_fotos, {stamp('l.creado_en')} AS creado_en,
    sum(CASE WHEN b.id IS NOT NULL AND b.duplicado_de IS NULL THEN 1 ELSE 0 END)::BIGINT
        AS cant_libros,
    row_number() OVER (PARTITION BY l.libreria_id ORDER BY l.creado_en DESC, l.id DESC) AS puesto
    FROM lotes l LEFT JOIN libros b ON b.lote_id = l.id
    WHERE l.estado = 'revision' AND l.archivado_en IS NULL
    GROUP BY l.id, l.libreria_id, l.cant_fotos, l.creado_en""",
)
define(
    "public_catalog",
    ["librerias", "libros"],
    f"""SELECT slug, b.id, titulo, autor, strftime(b.creado_en, '%Y-%m-%d') AS visto,
    row_number() OVER (PARTITION BY slug ORDER BY titulo, b.id) AS puesto
    FROM libros b JOIN librerias l ON l.id = libreria_id WHERE activa AND {PUBLIC}""",
)
define(
    "catalog_export_json",
    ["librerias", "libros"],
    f"""SELECT slug, CAST(0 AS BIGINT) AS pagina, CAST(1 AS BIGINT) AS paginas, count(*) AS n, '[' || string_agg(
        to_json({{'id': b.id, 'titulo': titulo, 'autor': autor,
            'visto': strftime(b.creado_en, '%Y-%m-%d')}})::VARCHAR, ',' ORDER BY titulo, b.id)
        || ']' AS documento
    FROM libros b JOIN librerias l ON l.id = libreria_id WHERE activa AND {PUBLIC}
    GROUP BY slug""",
)
define(
    "inventory_list",
    ["libros"],
    f"""SELECT libreria_id, id, titulo, autor, estado,
    row_number() OVER (PARTITION BY libreria_id ORDER BY titulo, id) AS puesto
    FROM libros WHERE {INVENTORY}""",
)
define(
    "inventory_search",
    ["consultas", "libros"],
    f"""SELECT c.consulta_id, c.libreria_id, lower(trim(c.q)) AS termino,
    count(b.id) AS resultados
    FROM consultas c LEFT JOIN (SELECT * FROM libros WHERE {INVENTORY}) b
      ON b.libreria_id = c.libreria_id
      AND (contains(lower(trim(b.titulo)), lower(trim(c.q)))
           OR contains(lower(trim(b.autor)), lower(trim(c.q))))
    GROUP BY ALL""",
)
define(
    "bulk_search",
    ["consultas", "libros"],
    f"""SELECT c.consulta_id, c.libreria_id, c.termino, count(b.id) AS resultados
    FROM (SELECT *, {search_form('q')} AS termino FROM consultas) c
    LEFT JOIN (SELECT id, libreria_id, {search_form('titulo')} AS t, {search_form('autor')} AS a
               FROM libros WHERE {PUBLIC}) b
      ON b.libreria_id = c.libreria_id AND c.termino <> ''
      AND (contains(b.t, c.termino) OR contains(b.a, c.termino))
    GROUP BY ALL""",
)
define(
    "search_hits",
    ["consultas", "libros"],
    f"""SELECT c.libreria_id, c.termino, b.id
    FROM (SELECT DISTINCT libreria_id, {search_form('q')} AS termino FROM consultas) c
    JOIN (SELECT id, libreria_id, {search_form('titulo')} AS t, {search_form('autor')} AS a
          FROM libros WHERE {PUBLIC}) b
      ON b.libreria_id = c.libreria_id AND c.termino <> ''
      AND (contains(b.t, c.termino) OR contains(b.a, c.termino))""",
)
define(
    "photo_owner_join",
    ["fotos", "lotes"],
    """SELECT f.id, f.lote_id, l.libreria_id, f.path, f.orden
    FROM fotos f, lotes l WHERE l.id = f.lote_id""",
)
define(
    "ownership_check",
    ["libros"],
    """SELECT a.id, a.quien AS libreria_id, EXISTS (SELECT 1 FROM libros b
        WHERE b.id = a.id AND b.libreria_id = a.quien) AS propio
    FROM (SELECT id, CASE WHEN orden = 0 THEN libreria_id + 1 ELSE libreria_id END AS quien
          FROM libros) a""",
)
define(
    "batch_status",
    ["lotes", "libros"],
    """SELECT l.id, l.estado, l.cant_fotos,
    count(DISTINCT b.foto_id) AS fotos_listas, count(b.duplicado_de) AS duplicados,
    CAST(0 AS BIGINT) AS pagina, CAST(1 AS BIGINT) AS paginas,
    count(b.id) FILTER (b.duplicado_de IS NULL) AS cant_libros,
    coalesce('[' || string_agg(to_json({'id': b.id, 'foto_id': b.foto_id, 'titulo': b.titulo,
        'autor': b.autor, 'titulo_raw': b.titulo_raw, 'autor_raw': b.autor_raw,
        'confianza': b.confianza, 'estado': b.estado})::VARCHAR, ',' ORDER BY b.confianza, b.id)
        FILTER (b.id IS NOT NULL AND b.duplicado_de IS NULL) || ']', '[]') AS libros
    FROM lotes l LEFT JOIN libros b ON b.lote_id = l.id GROUP BY l.id, l.estado, l.cant_fotos""",
)
define(
    "review_flags",
    ["libros"],
    """SELECT id, lote_id, foto_id, titulo, autor, confianza,
    NOT confianza < 0.7 AS aprobado, titulo <> titulo_raw OR autor <> autor_raw AS corregido
    FROM libros WHERE duplicado_de IS NULL""",
)
define(
    "review_order",
    ["libros"],
    """SELECT lote_id, foto_id, id, titulo, confianza, row_number() OVER (PARTITION BY lote_id
        ORDER BY foto_id, confianza >= 0.7 DESC, confianza, id)::INT AS puesto,
    row_number() OVER (PARTITION BY lote_id ORDER BY foto_id, confianza, id)::INT AS puesto_foto
    FROM libros WHERE duplicado_de IS NULL""",
)
define(
    "batch_books_by_confidence",
    ["libros"],
    """SELECT lote_id, id, titulo, confianza, row_number() OVER (PARTITION BY lote_id
        ORDER BY confianza, id)::INT AS puesto FROM libros WHERE duplicado_de IS NULL""",
)
define(
    "repeated_books",
    ["libros"],
    """SELECT lote_id, foto_id, id, titulo, autor, duplicado_de,
    row_number() OVER (PARTITION BY lote_id ORDER BY foto_id, titulo, id)::INT AS puesto FROM libros
    WHERE duplicado_de IS NOT NULL""",
)
define(
    "consult_links",
    ["librerias", "libros"],
    f"""SELECT id, autor_visible, mensaje, 'https://wa.me/' || whatsapp || '?text=' ||
        replace(replace(replace(replace(replace(url_encode(mensaje), '%21', '!'), '%27', ''''),
            '%28', '('), '%29', ')'), '%2A', '*') AS enlace,
    'https://example.org/' || slug || '?src=qr' AS qr, visto_el
    FROM (SELECT b.id, slug, whatsapp, CASE WHEN autor = '' THEN 'Autor no disponible'
            ELSE autor END AS autor_visible,
          'Hola, vi en el catalogo que tenes ' || titulo ||
          CASE WHEN autor = '' THEN '' ELSE ' de ' || autor END || '. Sigue disponible?'
          AS mensaje, strftime(b.creado_en, '%d/%m') AS visto_el
          FROM libros b JOIN librerias l ON l.id = libreria_id WHERE activa AND {PUBLIC})""",
)

_NOT_FOUND, _NO_SEARCH = (x.replace("'", "''") for x in (text.NOT_FOUND, text.NO_SEARCH))
define(
    "not_found_links",
    ["librerias", "consultas", "libros"],
    f"""SELECT consulta_id, libreria_id, mensaje, 'https://wa.me/' || whatsapp || '?text=' ||
        replace(replace(replace(replace(replace(url_encode(mensaje), '%21', '!'), '%27', ''''),
            '%28', '('), '%29', ')'), '%2A', '*') AS enlace
    FROM (SELECT c.consulta_id, c.libreria_id, l.whatsapp, CASE WHEN trim(c.q) = '' THEN '{_NO_SEARCH}'
            ELSE replace('{_NOT_FOUND}', '{{q}}', trim(c.q)) END AS mensaje
          FROM (SELECT *, {search_form('q')} AS termino FROM consultas) c
          JOIN librerias l ON l.id = c.libreria_id AND l.activa
          WHERE NOT EXISTS (SELECT 1 FROM libros b WHERE b.libreria_id = c.libreria_id AND {PUBLIC}
            AND c.termino <> '' AND (contains({search_form('b.titulo')}, c.termino)
              OR contains({search_form('b.autor')}, c.termino))))""",
)
define(
    "photos_in_order",
    ["fotos"],
    """SELECT id, lote_id, path, orden, row_number() OVER (PARTITION BY lote_id ORDER BY orden, id)::INT
    AS puesto FROM fotos""",
)

# --- metrics ------------------------------------------------------------------------------

STOCK = """SELECT libreria_id,
    sum(CASE WHEN archivado_en IS NULL AND estado = 'publicado' THEN 1 ELSE 0 END)::BIGINT
        AS publicados,
    sum(CASE WHEN archivado_en IS NULL AND estado = 'vendido' THEN 1 ELSE 0 END)::BIGINT
        AS vendidos,
    sum(CASE WHEN archivado_en IS NULL AND estado = 'pendiente' THEN 1 ELSE 0 END)::BIGINT
        AS pendientes,
    sum(CASE WHEN duplicado_de IS NULL THEN 0 ELSE 1 END)::BIGINT AS duplicados_detectados,
    sum(CASE WHEN archivado_en IS NULL THEN 0 ELSE 1 END)::BIGINT AS archivados
    FROM libros GROUP BY libreria_id"""
BATCHES = """SELECT libreria_id, count(id) AS lotes_total,
    sum(CASE estado WHEN 'publicado' THEN 1 ELSE 0 END)::BIGINT AS lotes_publicados,
    sum(CASE WHEN archivado_en IS NULL THEN 0 ELSE 1 END)::BIGINT AS lotes_archivados
    FROM lotes GROUP BY libreria_id"""
TRAFFIC = """SELECT libreria_id,
    sum((tipo = 'vista')::INT)::BIGINT AS vistas_total, sum(es_qr::INT)::BIGINT AS vistas_qr,
    sum((tipo = 'vista' AND NOT es_qr)::INT)::BIGINT AS vistas_link,
    sum((tipo = 'busqueda')::INT)::BIGINT AS busquedas_total,
    sum(sin_resultado::INT)::BIGINT AS busquedas_sin_resultado,
    sum((tipo = 'clic_whatsapp')::INT)::BIGINT AS clics_total,
    sum(generico::INT)::BIGINT AS clics_genericos,
    sum((tipo = 'clic_whatsapp' AND NOT generico)::INT)::BIGINT AS clics_por_libro,
    count(DISTINCT CASE WHEN session_id <> '' THEN session_id END) AS sesiones_unicas
    FROM marcas GROUP BY libreria_id"""

define("inventory_summary", ["libros"], STOCK)
define("batch_summary", ["lotes"], BATCHES)
for _name, _cols in {
    "view_metrics": "vistas_total, vistas_qr, vistas_link",
    "search_metrics": "busquedas_total, busquedas_sin_resultado",
    "click_metrics": "clics_total, clics_genericos, clics_por_libro",
    "unique_sessions": "sesiones_unicas",
}.items():
    define(_name, ["marcas"], f"SELECT libreria_id, {_cols} FROM ({TRAFFIC})")

_NUMBERS = [
    "publicados", "vendidos", "pendientes", "duplicados_detectados", "archivados",
    "lotes_total", "lotes_publicados", "lotes_archivados", "vistas_total", "vistas_qr",
    "vistas_link", "busquedas_total", "busquedas_sin_resultado", "clics_total",
    "clics_genericos", "clics_por_libro", "sesiones_unicas",
]
define(
    "shop_dashboard",
    ["librerias", "libros", "lotes", "marcas"],
    "SELECT l.id AS libreria_id, l.slug, l.nombre, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _NUMBERS)
    + f""" FROM librerias l LEFT JOIN ({STOCK}) s ON s.libreria_id = l.id
    LEFT JOIN ({BATCHES}) b ON b.libreria_id = l.id
    LEFT JOIN ({TRAFFIC}) t ON t.libreria_id = l.id""",
)
define(
    "top_zero_result_queries",
    ["marcas"],
    """SELECT libreria_id, puesto, termino, n FROM (
      SELECT *, row_number() OVER (PARTITION BY libreria_id
          ORDER BY n DESC, (ultimo).t DESC, (ultimo).i DESC)::INT AS puesto
      FROM (SELECT libreria_id, termino, count(*) AS n, max({'t': creado_en, 'i': id}) AS ultimo
            FROM marcas WHERE sin_resultado AND termino <> '' GROUP BY ALL)) WHERE puesto <= 15""",
)
define(
    "top_consulted_titles",
    ["marcas"],
    """SELECT libreria_id, puesto, titulo, n FROM (
      SELECT *, row_number() OVER (PARTITION BY libreria_id
          ORDER BY n DESC, (ultimo).t DESC, (ultimo).i DESC)::INT AS puesto
      FROM (SELECT libreria_id,
                CASE WHEN coalesce(titulo, '') = '' THEN '(sin título)' ELSE titulo END AS titulo,
                count(*) AS n, max({'t': creado_en, 'i': id}) AS ultimo
            FROM marcas WHERE tipo = 'clic_whatsapp' AND NOT generico GROUP BY ALL))
    WHERE puesto <= 15""",
)
define(
    "recent_events",
    ["eventos"],
    f"""SELECT libreria_id, puesto, id, CASE tipo
      WHEN 'vista' THEN '👀 Vista (' || json_extract_string(payload, '$.src') || ')'
      WHEN 'busqueda' THEN '🔎 Búsqueda: "' || json_extract_string(payload, '$.q') || '" — '
        || CASE {member('resultados')} WHEN 'true' THEN 'True'
            ELSE coalesce(json_extract_string(payload, '$.resultados'), '') END || ' resultado'
        || CASE WHEN {member('resultados')} IN ('1', 'true') THEN '' ELSE 's' END
      WHEN 'clic_whatsapp' THEN '💬 WhatsApp' || CASE
        WHEN NOT {nothing(member('generico'))} THEN ' (genérico)'
        WHEN NOT {nothing(member('titulo'))} THEN ': ' || json_extract_string(payload, '$.titulo')
        ELSE '' END
      WHEN 'inventario_reiniciado' THEN '🧹 Inventario reiniciado ('
        || {member('libros_archivados')} || ' libros)'
      WHEN 'lote_publicado' THEN '📚 Lote publicado (' || {member('publicados')} || ' libro'
        || CASE WHEN {member('publicados')} = '1' THEN '' ELSE 's' END || ')'
      ELSE tipo END AS linea, strftime(creado_en, '%d/%m %H:%M') AS cuando
    FROM (SELECT *, row_number() OVER (PARTITION BY libreria_id
              ORDER BY creado_en DESC, id DESC)::INT AS puesto FROM eventos)
    WHERE puesto <= 40""",
)
define(
    "demand_gap",
    ["marcas"],
    """SELECT libreria_id, termino, count(*) AS busquedas, sum(sin_resultado::INT)::BIGINT
        AS sin_resultado, sum(sin_resultado::INT) / count(*) AS brecha
    FROM marcas WHERE tipo = 'busqueda' AND termino <> '' GROUP BY libreria_id, termino""",
)

# --- text keys ----------------------------------------------------------------------------

define(
    "text_keys",
    ["libros"],
    f"""SELECT id, {slug('titulo')} AS slug, {normal('titulo_raw')} AS normal,
    {search_form('titulo_raw')} AS busqueda, trim(lower(titulo_raw)) AS panel,
    {key('titulo')} AS clave_titulo, {key('autor')} AS clave_autor,
    {main_title('titulo')} AS principal FROM libros""",
)
STATEMENTS["document_keys"] = (
    f"SELECT doc_id, md5({normal('text')}) AS normal, md5({key('text')}) AS clave, "
    f"md5({slug('text')}) AS slug, md5({main_title('text')}) AS principal FROM documents"
)

# --- model answers ------------------------------------------------------------------------

define(
    "response_parse",
    ["detecciones"],
    """SELECT modelo, lote_id, foto_id, pos, titulo_detectado, autor_detectado, titulo_corregido,
    autor_corregido, confianza, autor_descartado FROM detecciones""",
)
define(
    "failed_responses",
    ["respuestas"],
    "SELECT modelo, foto_id, 'json' AS motivo FROM respuestas WHERE NOT legible",
)
define(
    "author_guardrail",
    ["libros"],
    """SELECT id, CASE WHEN malo THEN '' ELSE autor END AS autor_corregido,
    CASE WHEN malo THEN least(confianza, 0.4) ELSE confianza END AS confianza,
    CASE WHEN malo THEN autor END AS autor_descartado
    FROM (SELECT *, autor <> '' AND (autor_leido = '' OR starts_with(autor_leido, 'Coleccion'))
          AS malo FROM libros)""",
)

# --- dedup --------------------------------------------------------------------------------

_KEYED = f"""SELECT *, {key('titulo')} AS kt, {main_title('titulo')} AS km, {key('autor')} AS ka
    FROM libros"""
define(
    "dedup_against_catalog",
    ["libros", "lotes"],
    f""", claves AS MATERIALIZED ({_KEYED}),
    nuevas AS (SELECT c.* FROM claves c JOIN lotes l ON l.id = c.lote_id
               WHERE l.estado = 'procesando'),
    indice AS (SELECT c.id, c.libreria_id, ka, kt, km FROM claves c JOIN lotes l ON l.id = c.lote_id
               WHERE l.estado <> 'procesando' AND c.archivado_en IS NULL
                 AND c.estado IN ('pendiente', 'publicado', 'vendido') AND kt <> ''),
    candidatas AS (
      SELECT n.id, i.id AS vieja, 0 AS paso FROM nuevas n JOIN indice i
        ON i.libreria_id = n.libreria_id AND i.kt = n.kt
        AND (i.ka = n.ka OR i.ka = '' OR n.ka = '')
      UNION ALL
      SELECT n.id, i.id, 0 FROM nuevas n JOIN indice i
        ON i.libreria_id = n.libreria_id AND i.km = n.kt AND n.kt <> ''
        AND (i.ka = n.ka OR i.ka = '' OR n.ka = '')
      UNION ALL
      SELECT n.id, i.id, 1 FROM nuevas n JOIN indice i
        ON i.libreria_id = n.libreria_id AND i.kt = n.km AND n.km <> ''
        AND (i.ka = n.ka OR i.ka = '' OR n.ka = '')),
    primeras AS (SELECT id, min({{'p': paso, 'v': vieja}}).v AS vieja FROM candidatas GROUP BY id)
    SELECT n.id, n.libreria_id, p.vieja AS duplicado_de
    FROM nuevas n LEFT JOIN primeras p ON p.id = n.id""",
)

# One step handles the next reading of every shop against all rows kept so far.
_WALK = f""", claves AS MATERIALIZED ({_KEYED}),
    fila AS MATERIALIZED (SELECT id, libreria_id, lote_id, kt, km, ka, row_number() OVER (
        PARTITION BY libreria_id ORDER BY lote_id, orden, id) AS paso FROM claves),
    marcha(paso, libreria_id, id, lote_id, kt, km, ka, viejo, queda) USING KEY (paso, libreria_id)
    AS (
      SELECT paso, libreria_id, id, lote_id, kt, km, ka, CAST(NULL AS BIGINT), true
      FROM fila WHERE paso = 1
      UNION
      SELECT f.paso, f.libreria_id, f.id, f.lote_id, f.kt, f.km, f.ka, f.viejo,
        f.viejo IS NULL OR NOT (f.visto OR f.propio)
      FROM (
        SELECT g.*, EXISTS (SELECT 1 FROM recurring.marcha w WHERE w.libreria_id = g.libreria_id
                AND w.lote_id = g.lote_id AND w.queda AND w.viejo = g.viejo) AS visto,
          EXISTS (SELECT 1 FROM recurring.marcha w WHERE w.libreria_id = g.libreria_id
                AND w.lote_id = g.lote_id AND w.id = g.viejo) AS propio
        FROM (
          SELECT n.paso, n.libreria_id, n.id, n.lote_id, n.kt, n.km, n.ka,
            coalesce(min_by(r.id, r.paso) FILTER (r.kt = n.kt OR r.km = n.kt),
                     min_by(r.id, r.paso) FILTER (r.kt = n.km)) AS viejo
          FROM (SELECT DISTINCT paso FROM marcha) m JOIN fila n ON n.paso = m.paso + 1
          LEFT JOIN recurring.marcha r ON r.libreria_id = n.libreria_id AND r.viejo IS NULL
            AND n.kt <> '' AND r.kt <> '' AND (r.ka = n.ka OR r.ka = '' OR n.ka = '')
            AND (r.kt = n.kt OR r.km = n.kt OR (n.km <> '' AND r.kt = n.km))
          GROUP BY ALL) g) f)"""
_REBUILT = """SELECT m.id, m.libreria_id, m.lote_id, b.titulo, b.autor,
    CASE WHEN m.viejo IS NULL THEN 'pendiente' ELSE 'descartado' END AS estado,
    m.viejo AS duplicado_de FROM marcha m JOIN libros b ON b.id = m.id WHERE m.queda"""
define("dedup_sequential", ["libros"], f"{_WALK} {_REBUILT}", recursive=True)
define("stream_dedup", ["libros"], f"{_WALK} {_REBUILT}", recursive=True)
define("stream_dedup_parts", ["libros"], f"{_WALK} {_REBUILT}", recursive=True)
define(
    "dedup_counters",
    ["libros"],
    f"""{_WALK} SELECT lote_id, count(*) FILTER (viejo IS NULL) AS nuevos,
    count(viejo) AS duplicados FROM marcha WHERE queda GROUP BY lote_id""",
    recursive=True,
)

# The walk with decisions in between: an entry counts from one turn of its shop to another.
define(
    "dedup_with_decisions",
    ["libros", "lotes"],
    f""", turnos AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY libreria_id ORDER BY ts, lote_id) AS turno
      FROM (SELECT id AS lote_id, libreria_id, estado AS estado_lote, creado_en + to_minutes(id % 1440) AS ts FROM lotes)),
    claves AS MATERIALIZED (SELECT b.libreria_id, b.lote_id, b.titulo, b.autor, t.ts, t.turno, t.estado_lote,
        row_number() OVER (ORDER BY t.ts, b.lote_id, b.orden, b.id) AS id,
        {key('titulo')} AS kt, {main_title('titulo')} AS km, {key('autor')} AS ka
      FROM libros b JOIN turnos t USING (lote_id)),
    ultimos AS MATERIALIZED (SELECT libreria_id, ts, max(turno) AS turno FROM turnos GROUP BY ALL),
    reinicios AS (SELECT libreria_id, TIMESTAMP '2024-01-10' + to_days((libreria_id % 5)::INT) AS cuando
        FROM turnos GROUP BY 1 UNION ALL
      SELECT libreria_id, TIMESTAMP '2024-01-20' FROM turnos WHERE libreria_id % 3 = 0 GROUP BY 1),
    fines AS MATERIALIZED (SELECT t.lote_id, min(1 + (SELECT coalesce(max(u.turno), 0) FROM turnos u
          WHERE u.libreria_id = r.libreria_id AND u.ts <= r.cuando)) AS fin
      FROM turnos t JOIN reinicios r ON r.libreria_id = t.libreria_id AND r.cuando > t.ts GROUP BY 1),
    tocados AS MATERIALIZED (SELECT c.*, f.fin,
        CASE WHEN id % 9 = 0 AND id % 12 > 0 AND (id // 9) % 5 < 4 THEN ts + to_days((id % 12)::INT) END AS e_ts,
        ['pendiente', 'publicado', 'descartado', 'vendido', 'raro'][(id // 9) % 5 + 1] AS e_estado,
        CASE WHEN id % 2 = 0 THEN titulo ELSE 'Titulo ' || (id % 40) END AS e_titulo,
        CASE WHEN id % 4 = 0 THEN '' ELSE autor END AS e_autor,
        CASE WHEN estado_lote IN ('publicado', 'descartado') THEN ts + INTERVAL 1 DAY END AS m_ts,
        CASE WHEN id % 31 = 0 THEN ts + INTERVAL 3 DAY END AS x_ts
      FROM claves c LEFT JOIN fines f USING (lote_id)),
    limites AS (SELECT id, ts AS cuando, true AS inicio FROM tocados UNION ALL
      SELECT id, e_ts, false FROM tocados WHERE e_ts IS NOT NULL UNION ALL
      SELECT id, m_ts, false FROM tocados WHERE m_ts IS NOT NULL UNION ALL
      SELECT id, x_ts, false FROM tocados WHERE x_ts IS NOT NULL),
    pasos AS (SELECT t.*, l.cuando, l.inicio, CASE WHEN l.inicio THEN t.turno + 1 ELSE coalesce(u.turno, 0) + 1 END AS desde
      FROM (SELECT l.*, t.libreria_id AS tienda FROM limites l JOIN tocados t USING (id)) l JOIN tocados t USING (id)
      ASOF LEFT JOIN ultimos u ON u.libreria_id = l.tienda AND l.cuando >= u.ts),
    estados AS (SELECT *, e_ts IS NOT NULL AND e_ts <= cuando AS editado,
        m_ts IS NOT NULL AND m_ts <= cuando AND (e_ts IS NULL OR e_ts > cuando OR m_ts >= e_ts) AS movido,
        least(lead(desde, 1, 1000000000) OVER (PARTITION BY id ORDER BY cuando, NOT inicio), coalesce(fin, 1000000000)) AS hasta
      FROM pasos WHERE true),
    vivos AS (SELECT *, CASE WHEN editado THEN e_estado ELSE 'pendiente' END AS si_nueva,
        CASE WHEN editado THEN e_estado ELSE 'descartado' END AS si_repetida FROM estados
      WHERE x_ts IS NULL OR x_ts > cuando),
    vigencias AS MATERIALIZED (
      SELECT id, kt, km, ka, turno AS desde, turno + 1 AS hasta, true AS nueva, false AS repetida FROM claves
      UNION ALL
      SELECT id, CASE WHEN editado THEN {key('e_titulo')} ELSE kt END, CASE WHEN editado THEN {main_title('e_titulo')} ELSE km END,
        CASE WHEN editado THEN {key('e_autor')} ELSE ka END, desde, hasta,
        CASE WHEN si_nueva = 'pendiente' AND movido THEN estado_lote ELSE si_nueva END <> 'descartado',
        CASE WHEN si_repetida = 'pendiente' AND movido THEN estado_lote ELSE si_repetida END <> 'descartado'
      FROM vivos WHERE desde < hasta),
    fila AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY libreria_id ORDER BY id) AS paso FROM claves),
    marcha(paso, libreria_id, id, lote_id, viejo, queda) USING KEY (paso, libreria_id) AS (
      SELECT paso, libreria_id, id, lote_id, CAST(NULL AS BIGINT), true FROM fila WHERE paso = 1
      UNION
      SELECT f.paso, f.libreria_id, f.id, f.lote_id, f.viejo, f.viejo IS NULL OR NOT (f.visto OR f.propio)
      FROM (
        SELECT g.*, EXISTS (SELECT 1 FROM recurring.marcha w WHERE w.libreria_id = g.libreria_id
                AND w.lote_id = g.lote_id AND w.queda AND w.viejo = g.viejo) AS visto,
          EXISTS (SELECT 1 FROM recurring.marcha w WHERE w.libreria_id = g.libreria_id
                AND w.lote_id = g.lote_id AND w.id = g.viejo) AS propio
        FROM (
          SELECT n.paso, n.libreria_id, n.id, n.lote_id,
            coalesce(min(v.id) FILTER (v.kt = n.kt OR v.km = n.kt), min(v.id) FILTER (v.kt = n.km)) AS viejo
          FROM (SELECT DISTINCT paso FROM marcha) m JOIN fila n ON n.paso = m.paso + 1
          LEFT JOIN (SELECT r.libreria_id, v.* FROM recurring.marcha r JOIN vigencias v ON v.id = r.id
              AND r.queda AND CASE WHEN r.viejo IS NULL THEN v.nueva ELSE v.repetida END) v
            ON v.libreria_id = n.libreria_id AND v.desde <= n.turno AND n.turno < v.hasta
            AND n.kt <> '' AND v.kt <> '' AND (v.ka = n.ka OR v.ka = '' OR n.ka = '')
            AND (v.kt = n.kt OR v.km = n.kt OR (n.km <> '' AND v.kt = n.km))
          GROUP BY ALL) g) f)
    SELECT m.id, m.libreria_id, m.lote_id, c.titulo, c.autor,
    CASE WHEN m.viejo IS NULL THEN 'pendiente' ELSE 'descartado' END AS estado, m.viejo AS duplicado_de
    FROM marcha m JOIN claves c ON c.id = m.id WHERE m.queda""",
    recursive=True,
)

# The same walk over the answers of waiting batches; the catalogue stands before the first step.
_WAITING = f""", claves AS MATERIALIZED (SELECT d.foto_id * 1048576 + d.pos AS id, l.libreria_id, d.lote_id, d.foto_id,
        d.titulo_detectado AS titulo_raw, d.autor_detectado AS autor_raw, d.titulo_corregido AS titulo,
        d.autor_corregido AS autor, d.confianza, d.foto_id % 10 AS orden,
        {key('titulo_corregido')} AS kt, {main_title('titulo_corregido')} AS km, {key('autor_corregido')} AS ka
      FROM detecciones d JOIN lotes l ON l.id = d.lote_id WHERE l.estado = 'procesando'),
    catalogo AS MATERIALIZED (SELECT b.id, b.libreria_id, b.lote_id, {key('titulo')} AS kt,
        {main_title('titulo')} AS km, {key('autor')} AS ka,
        1 - row_number() OVER (PARTITION BY b.libreria_id ORDER BY b.id DESC) AS paso
      FROM libros b JOIN lotes l ON l.id = b.lote_id WHERE l.estado <> 'procesando'
        AND b.archivado_en IS NULL AND b.estado IN ('pendiente', 'publicado', 'vendido')),"""
_PROCESS = _WAITING + _WALK[_WALK.index("fila AS MATERIALIZED") :].replace(
    """      SELECT paso, libreria_id, id, lote_id, kt, km, ka, CAST(NULL AS BIGINT), true
      FROM fila WHERE paso = 1""",
    """      SELECT paso, libreria_id, id, lote_id, kt, km, ka, CAST(NULL AS BIGINT), true
      FROM catalogo""",
)
# Rows that stay get serial ids after the greatest one of the other batches' books.
_SERIAL = f"""{_PROCESS}, nuevos AS (SELECT m.id, m.viejo, (SELECT max(b.id) FROM libros b JOIN lotes l ON l.id = b.lote_id
        WHERE l.estado <> 'procesando') + row_number() OVER (ORDER BY c.lote_id, c.orden, c.foto_id, c.id) AS serie
      FROM marcha m JOIN claves c ON c.id = m.id WHERE m.queda AND m.paso > 0),
    fotos_nuevas AS (SELECT foto_id, row_number() OVER (ORDER BY lote_id, foto_id) AS foto FROM respuestas r
      JOIN lotes l ON l.id = r.lote_id WHERE l.estado = 'procesando')"""
define(
    "process_batches_books",
    ["detecciones", "libros", "lotes", "respuestas"],
    f"""{_SERIAL} SELECT m.serie AS id, c.libreria_id, c.lote_id, c.foto_id, c.titulo_raw, c.autor_raw, c.titulo, c.autor,
    c.confianza, CASE WHEN m.viejo IS NULL THEN 'pendiente' ELSE 'descartado' END AS estado,
    coalesce(v.serie, m.viejo) AS duplicado_de
    FROM nuevos m JOIN claves c ON c.id = m.id LEFT JOIN nuevos v ON v.id = m.viejo""",
    recursive=True,
)
define(
    "intake_to_books",
    ["detecciones", "libros", "lotes", "respuestas"],
    f"""{_SERIAL} SELECT m.serie AS id, c.libreria_id, c.lote_id, f.foto AS foto_id, c.titulo_raw, c.titulo, c.autor,
    CASE WHEN m.viejo IS NULL THEN 'pendiente' ELSE 'descartado' END AS estado, coalesce(v.serie, m.viejo) AS duplicado_de
    FROM nuevos m JOIN claves c ON c.id = m.id JOIN fotos_nuevas f ON f.foto_id = c.foto_id
    LEFT JOIN nuevos v ON v.id = m.viejo""",
    recursive=True,
)
define(
    "process_batches_state",
    ["lotes"],
    """SELECT id, libreria_id, CASE estado WHEN 'procesando' THEN 'revision' ELSE estado END AS estado,
    cant_fotos FROM lotes""",
)
define(
    "process_batches_counters",
    ["detecciones", "libros", "lotes"],
    f"""{_PROCESS} SELECT l.id AS lote_id, l.libreria_id, count(m.id) FILTER (m.viejo IS NULL) AS nuevos,
    count(m.viejo) AS duplicados FROM lotes l LEFT JOIN marcha m ON m.lote_id = l.id AND m.queda AND m.paso > 0
    WHERE l.estado = 'procesando' GROUP BY l.id, l.libreria_id""",
    recursive=True,
)
define(
    "process_batches_failed",
    ["respuestas", "lotes"],
    """SELECT r.foto_id, r.lote_id, 'json' AS motivo FROM respuestas r JOIN lotes l ON l.id = r.lote_id
    WHERE l.estado = 'procesando' AND NOT legible""",
)

# --- intake -------------------------------------------------------------------------------

_PUBLIC_TYPES = "('vista', 'busqueda', 'clic_whatsapp', 'scan_qr')"
define(
    "event_validation",
    ["eventos_raw", "librerias"],
    f"""SELECT e.id, CASE WHEN l.id IS NOT NULL AND tipo IN {_PUBLIC_TYPES} THEN l.id END
        AS libreria_id, tipo, payload,
    CASE WHEN l.id IS NOT NULL AND tipo IN {_PUBLIC_TYPES} THEN nullif(session_id, '')
        ELSE session_id END AS session_id,
    CASE WHEN l.id IS NULL THEN 'slug' WHEN tipo NOT IN {_PUBLIC_TYPES} THEN 'tipo' END AS motivo
    FROM eventos_raw e LEFT JOIN librerias l ON l.slug = e.slug AND l.activa""",
)
define(
    "shop_registration",
    ["altas", "librerias"],
    f"""SELECT solicitud, slug, nombre, whatsapp, mensaje_wa_template,
    CASE WHEN NOT bien THEN 'whatsapp'
         WHEN slug IN (SELECT slug FROM librerias) OR solicitud <> primera THEN 'slug' END AS motivo
    FROM (SELECT *, min(CASE WHEN bien THEN solicitud END) OVER (PARTITION BY slug) AS primera
      FROM (SELECT solicitud, trim(nombre) AS nombre, trim(whatsapp) AS whatsapp,
            {slug("CASE WHEN slug = '' THEN nombre ELSE slug END")} AS slug,
            CASE WHEN trim(mensaje_wa_template) = '' THEN '{TEMPLATE}'
                 ELSE trim(mensaje_wa_template) END AS mensaje_wa_template,
            regexp_full_match(trim(whatsapp), '[0-9]{{10,15}}') AS bien FROM altas))""",
)
define(
    "batch_size_check",
    ["libros"],
    """SELECT lote_id, libreria_id, count(*) AS cant_fotos,
    CASE WHEN count(*) > 10 THEN 'cantidad' ELSE '' END AS motivo FROM libros GROUP BY 1, 2""",
)
define(
    "batch_photos",
    ["libros"],
    """SELECT lote_id, (row_number() OVER (PARTITION BY lote_id ORDER BY id) - 1)::INT AS orden,
    foto_id || '/' || id AS path FROM libros QUALIFY count(*) OVER (PARTITION BY lote_id) <= 10""",
)

# --- lifecycle ----------------------------------------------------------------------------

_DATES = f"{stamp('publicado_en')} AS publicado_en, {stamp('vendido_en')} AS vendido_en"
_AT = "TIMESTAMP '2024-03-01 12:00:00'"
define(
    "apply_edits",
    ["libros", "ediciones"],
    f"""SELECT id, lote_id, titulo, autor, estado, {_DATES} FROM (
      SELECT b.id, b.lote_id,
        CASE WHEN e.ult IS NULL THEN b.titulo ELSE trim((e.ult).titulo) END AS titulo,
        CASE WHEN e.ult IS NULL THEN b.autor ELSE trim((e.ult).autor) END AS autor,
        CASE WHEN e.ult IS NULL THEN b.estado ELSE (e.ult).estado END AS estado,
        coalesce(e.pub, b.publicado_en) AS publicado_en,
        coalesce(e.ven, b.vendido_en) AS vendido_en
      FROM libros b LEFT JOIN (
        SELECT libro_id, arg_max({{'titulo': titulo, 'autor': autor, 'estado': estado}}, ts) AS ult,
          max(ts) FILTER (estado = 'publicado') AS pub, max(ts) FILTER (estado = 'vendido') AS ven
        FROM ediciones WHERE estado <> 'perdido' GROUP BY libro_id) e ON e.libro_id = b.id)""",
)
define(
    "rejected_edits",
    ["ediciones"],
    "SELECT libro_id, estado, 'estado' AS motivo FROM ediciones WHERE estado = 'perdido'",
)
define(
    "review_decisions",
    ["libros", "lotes"],
    f"""SELECT id, lote_id, titulo, autor, estado, {_DATES} FROM (
      SELECT b.id, b.lote_id, b.titulo, b.autor,
        CASE WHEN NOT toca THEN b.estado WHEN sale THEN 'publicado' ELSE 'descartado' END AS estado,
        CASE WHEN toca AND sale THEN {_AT} ELSE b.publicado_en END AS publicado_en, b.vendido_en
      FROM (SELECT x.*, l.estado IN ('revision', 'procesando') AND x.duplicado_de IS NULL AS toca,
              l.estado = 'revision' AND x.confianza >= 0.7 AS sale
            FROM libros x JOIN lotes l ON l.id = x.lote_id) b)""",
)
define(
    "publish_books",
    ["libros", "lotes"],
    f"""SELECT id, lote_id, titulo, autor, estado, {_DATES} FROM (
      SELECT b.id, b.lote_id, b.titulo, b.autor,
        CASE WHEN l.estado = 'revision' AND b.estado = 'pendiente' THEN 'publicado'
             ELSE b.estado END AS estado,
        CASE WHEN l.estado = 'revision' AND b.estado = 'pendiente' THEN {_AT}
             ELSE b.publicado_en END AS publicado_en, b.vendido_en
      FROM libros b JOIN lotes l ON l.id = b.lote_id)""",
)
define(
    "publish_batches",
    ["lotes"],
    f"""SELECT id, libreria_id, CASE estado WHEN 'revision' THEN 'publicado' ELSE estado END
        AS estado, cant_fotos,
    {stamp(f"CASE estado WHEN 'revision' THEN {_AT} ELSE publicado_en END")} AS publicado_en
    FROM lotes""",
)
define(
    "publish_events",
    ["libros", "lotes"],
    """SELECT l.libreria_id, 'lote_publicado' AS tipo,
    '{"lote_id":' || l.id || ',"publicados":' || (SELECT count(*) FROM libros b
        WHERE b.lote_id = l.id AND b.estado IN ('publicado', 'pendiente')) || '}' AS payload,
    CAST(NULL AS VARCHAR) AS session_id, '2024-03-01 12:00:00' AS creado_en
    FROM lotes l WHERE l.estado = 'revision'""",
)
define(
    "discard_batch",
    ["libros", "lotes"],
    """SELECT b.id, 'libro' AS clase, CASE WHEN l.estado = 'procesando' AND b.estado = 'pendiente'
        THEN 'descartado' ELSE b.estado END AS estado
    FROM libros b JOIN lotes l ON l.id = b.lote_id
    UNION ALL
    SELECT id, 'lote', CASE estado WHEN 'procesando' THEN 'descartado' ELSE estado END FROM lotes""",
)
define(
    "close_processing",
    ["lotes"],
    """SELECT id, libreria_id, CASE estado WHEN 'procesando' THEN 'revision' ELSE estado END
    AS estado FROM lotes""",
)
_ARCHIVED = stamp(f"CASE WHEN l.activa THEN archivado_en ELSE coalesce(archivado_en, {_AT}) END")
define(
    "reset_inventory",
    ["libros", "lotes", "librerias"],
    f"""SELECT b.id, 'libro' AS clase, {_ARCHIVED} AS archivado_en
    FROM libros b JOIN librerias l ON l.id = b.libreria_id
    UNION ALL
    SELECT b.id, 'lote', {_ARCHIVED} FROM lotes b JOIN librerias l ON l.id = b.libreria_id""",
)
define(
    "reset_events",
    ["libros", "librerias"],
    """SELECT l.id AS libreria_id, 'inventario_reiniciado' AS tipo,
    '{"libros_archivados":' || count(b.id) || '}' AS payload, CAST(NULL AS VARCHAR) AS session_id,
    '2024-03-01 12:00:00' AS creado_en
    FROM librerias l LEFT JOIN libros b ON b.libreria_id = l.id AND b.archivado_en IS NULL
    WHERE NOT l.activa GROUP BY l.id""",
)
define(
    "mark_sold",
    ["libros"],
    f"""SELECT id, lote_id, titulo, autor, estado, {_DATES} FROM (
      SELECT id, lote_id, titulo, autor, CASE WHEN {PUBLIC} THEN 'vendido' ELSE estado END AS estado,
        publicado_en, CASE WHEN {PUBLIC} THEN {_AT} ELSE vendido_en END AS vendido_en
      FROM libros)""",
)
define(
    "restore_raw",
    ["libros"],
    "SELECT id, titulo_raw AS titulo, autor_raw AS autor, estado FROM libros",
)
define(
    "delete_book",
    ["libros"],
    """SELECT id, estado, CASE WHEN duplicado_de IN (SELECT id FROM libros
        WHERE estado = 'pendiente') THEN NULL ELSE duplicado_de END AS duplicado_de
    FROM libros WHERE estado <> 'pendiente'""",
)
define(
    "delete_shop",
    ["librerias", "lotes", "fotos", "libros", "eventos"],
    """, quedan AS (SELECT id FROM librerias WHERE activa)
    SELECT id, 'librerias' AS tabla FROM quedan
    UNION ALL SELECT id, 'lotes' FROM lotes WHERE libreria_id IN (FROM quedan)
    UNION ALL SELECT f.id, 'fotos' FROM fotos f JOIN lotes l ON l.id = f.lote_id
        WHERE l.libreria_id IN (FROM quedan)
    UNION ALL SELECT id, 'libros' FROM libros WHERE libreria_id IN (FROM quedan)
    UNION ALL SELECT id, 'eventos' FROM eventos WHERE libreria_id IN (FROM quedan)""",
)
define(
    "state_check",
    ["ediciones", "lotes"],
    """SELECT estado, CASE WHEN estado = 'perdido' THEN 'estado' END AS motivo, count(*) AS n
    FROM (SELECT estado FROM ediciones UNION ALL SELECT estado FROM lotes) GROUP BY 1, 2""",
)

# --- cohorts ------------------------------------------------------------------------------

_MONDAY = "date_trunc('week', {})"
_READ = f"""SELECT libreria_id, {_MONDAY.format('creado_en')} AS semana,
    count(*) AS libros_leidos,
    sum((titulo <> titulo_raw OR autor <> autor_raw)::INT)::BIGINT AS corregidos
    FROM libros GROUP BY 1, 2"""
_WEEKS = f"""SELECT libreria_id, {_MONDAY.format('creado_en')} AS semana,
    count(*) FILTER (tipo = 'lote_publicado') AS lotes_publicados,
    coalesce(sum(publicados), 0)::BIGINT AS libros_publicados,
    count(*) FILTER (tipo = 'vista') AS vistas, count(*) FILTER (tipo = 'busqueda') AS busquedas,
    count(*) FILTER (tipo = 'clic_whatsapp') AS clics FROM marcas GROUP BY 1, 2"""
_SESSIONS = """SELECT libreria_id, session_id, min(creado_en) AS inicio, max(creado_en) AS fin,
    count(*) FILTER (tipo = 'busqueda') AS busquedas,
    count(*) FILTER (tipo = 'clic_whatsapp') AS clics
    FROM marcas WHERE session_id <> '' GROUP BY 1, 2"""
define(
    "weekly_cohort",
    ["librerias", "libros", "marcas"],
    f""", inicios AS (SELECT id AS libreria_id, {_MONDAY.format('creado_en')} AS semana FROM librerias
        UNION ALL SELECT libreria_id, {_MONDAY.format('creado_en')} FROM marcas
        UNION ALL SELECT libreria_id, {_MONDAY.format('creado_en')} FROM libros)
    SELECT s.libreria_id, strftime(s.semana, '%Y-%m-%d') AS semana,
    coalesce(lotes_publicados, 0) AS lotes_publicados,
    coalesce(libros_publicados, 0) AS libros_publicados, coalesce(vistas, 0) AS vistas,
    coalesce(busquedas, 0) AS busquedas, coalesce(clics, 0) AS clics,
    coalesce(libros_leidos, 0) AS libros_leidos, coalesce(corregidos, 0) AS corregidos,
    corregidos / libros_leidos AS parte_corregida
    FROM (SELECT libreria_id, unnest(generate_series(CAST(min(semana) AS TIMESTAMP),
            (SELECT CAST(max(semana) AS TIMESTAMP) FROM inicios), INTERVAL 7 DAY)) AS semana
        FROM inicios GROUP BY libreria_id) s
    LEFT JOIN ({_WEEKS}) w ON w.libreria_id = s.libreria_id AND w.semana = s.semana
    LEFT JOIN ({_READ}) r ON r.libreria_id = s.libreria_id AND r.semana = s.semana""",
)
define(
    "weekly_shop_edits",
    ["libros", "ediciones"],
    f"""SELECT libreria_id, strftime({_MONDAY.format('creado_en')}, '%Y-%m-%d') AS semana,
    count(*) AS libros_leidos, count(*) FILTER (EXISTS (SELECT 1 FROM ediciones e
        WHERE e.libro_id = b.id AND e.estado <> 'perdido' AND (trim(e.titulo) <> trim(b.titulo)
            OR trim(e.autor) <> trim(b.autor)))) AS editados
    FROM libros b GROUP BY 1, 2""",
)
define(
    "innovation_metrics",
    ["libros", "marcas"],
    f"""SELECT libreria_id, strftime(semana, '%Y-%m-%d') AS semana,
    corregidos / libros_leidos AS parte_corregida, coalesce(escaneos_qr, 0) AS escaneos_qr,
    mediana_busquedas, con_clic / sesiones AS parte_clic,
    corregidos / libros_leidos < 0.2 AS correccion_bien, coalesce(escaneos_qr, 0) > 0 AS qr_bien,
    mediana_busquedas >= 1 AS busqueda_bien, con_clic / sesiones >= 0.05 AS clic_bien
    FROM ({_READ}) FULL JOIN (SELECT libreria_id, {_MONDAY.format('inicio')} AS semana,
        count(*) AS sesiones, median(busquedas) AS mediana_busquedas,
        count(*) FILTER (clics > 0) AS con_clic FROM ({_SESSIONS}) GROUP BY 1, 2)
        USING (libreria_id, semana)
    FULL JOIN (SELECT libreria_id, {_MONDAY.format('creado_en')} AS semana,
        count(*) FILTER (es_qr) AS escaneos_qr FROM marcas GROUP BY 1, 2)
        USING (libreria_id, semana)""",
)
define(
    "bounce_share",
    ["marcas"],
    f"""SELECT libreria_id, count(*) AS sesiones, count(*) FILTER (busquedas = 0 AND clics = 0
        AND fin - inicio < INTERVAL 20 SECOND) AS rebotes,
    count(*) FILTER (busquedas = 0 AND clics = 0 AND fin - inicio < INTERVAL 20 SECOND) / count(*)
        AS parte_rebote FROM ({_SESSIONS}) GROUP BY libreria_id""",
)
define(
    "demand_gap_share",
    ["marcas"],
    """SELECT libreria_id, count(*) AS busquedas, count(*) FILTER (sin_resultado) AS sin_resultado,
    count(*) FILTER (sin_resultado) / count(*) AS brecha
    FROM marcas WHERE tipo = 'busqueda' GROUP BY libreria_id""",
)
define(
    "batch_gaps",
    ["lotes"],
    f"""SELECT id, libreria_id, {stamp('creado_en')} AS creado_en,
    date_diff('second', creado_en, lead(creado_en) OVER (PARTITION BY libreria_id
        ORDER BY creado_en, id)) / 3600 AS horas_al_siguiente FROM lotes""",
)
define(
    "batch_cadence",
    ["librerias", "lotes"],
    """SELECT l.id AS libreria_id, date_diff('second', l.creado_en, b.primero) / 3600
        AS horas_primer_lote,
    coalesce(date_diff('second', l.creado_en, b.primero) <= 72 * 3600, false) AS a_tiempo,
    coalesce(b.n, 0) AS lotes, coalesce(b.n, 0) > 1 AS segunda_tanda
    FROM librerias l LEFT JOIN (SELECT libreria_id, min(creado_en) AS primero, count(*) AS n
        FROM lotes GROUP BY 1) b ON b.libreria_id = l.id""",
)
_ACTS = """, actos AS (SELECT l.id AS libreria_id, a.lote,
        CAST(floor(date_diff('day', CAST(l.creado_en AS DATE), CAST(a.creado_en AS DATE)) / 7) AS BIGINT)
            + 1 AS semana
      FROM librerias l JOIN (SELECT libreria_id, creado_en, true AS lote FROM lotes
          UNION ALL SELECT libreria_id, creado_en, false FROM eventos) a ON a.libreria_id = l.id)"""
define(
    "retention",
    ["librerias", "lotes", "eventos"],
    f"""{_ACTS} SELECT libreria_id, semana, count(*) FILTER (lote) AS lotes,
    count(*) FILTER (NOT lote) AS eventos FROM actos GROUP BY 1, 2""",
)
define(
    "retention_flags",
    ["librerias", "lotes", "eventos"],
    f"""{_ACTS} SELECT l.id AS libreria_id,
    count(DISTINCT semana) FILTER (semana >= 1) AS semanas_activas, max(semana) AS ultima_semana,
    coalesce(bool_or(semana = 4), false) AS retiene_4,
    coalesce(bool_or(semana = 2 AND lote), false) AS lote_semana_2,
    coalesce(bool_or(semana = 3 AND lote), false) AS lote_semana_3
    FROM librerias l LEFT JOIN actos a ON a.libreria_id = l.id GROUP BY l.id""",
)
define(
    "cycles",
    ["libros"],
    """SELECT libreria_id, ciclo, abierto, libros, publicados, vendidos,
    libros - lag(libros) OVER (PARTITION BY libreria_id ORDER BY ciclo) AS cambio_libros
    FROM (SELECT libreria_id, ciclo, bool_and(archivado_en IS NULL) AS abierto, count(*) AS libros,
            count(*) FILTER (estado = 'publicado') AS publicados,
            count(*) FILTER (estado = 'vendido') AS vendidos
          FROM (SELECT *, dense_rank() OVER (PARTITION BY libreria_id
                ORDER BY archivado_en NULLS LAST)::INT AS ciclo FROM libros) GROUP BY 1, 2)""",
)
define(
    "no_click_shops",
    ["librerias", "eventos"],
    """SELECT l.id AS libreria_id, count(e.id) AS clics, count(e.id) = 0 AS sin_consultas
    FROM librerias l LEFT JOIN eventos e ON e.libreria_id = l.id AND e.tipo = 'clic_whatsapp'
      AND e.creado_en >= l.creado_en AND e.creado_en < l.creado_en + INTERVAL 21 DAY
    GROUP BY l.id""",
)
define(
    "shop_signal",
    ["librerias", "lotes", "eventos"],
    """SELECT id AS libreria_id, lotes, clics, busquedas, CASE WHEN lotes = 0 THEN 'sin_lotes'
        WHEN lotes < 2 THEN 'pivot_de_canal'
        WHEN clics + busquedas = 0 THEN 'pivot_de_segmento'
        WHEN clics = 0 THEN 'sin_consultas' ELSE 'perseverar' END AS senal
    FROM (SELECT l.id, (SELECT count(*) FROM lotes b WHERE b.libreria_id = l.id) AS lotes,
        (SELECT count(*) FROM eventos e WHERE e.libreria_id = l.id AND tipo = 'clic_whatsapp')
            AS clics,
        (SELECT count(*) FROM eventos e WHERE e.libreria_id = l.id AND tipo = 'busqueda')
            AS busquedas FROM librerias l)""",
)

# --- quality ------------------------------------------------------------------------------

_TRUTH = f"""esperados AS MATERIALIZED (SELECT foto_id,
      (row_number() OVER (PARTITION BY foto_id ORDER BY id DESC) - 1)::INT AS pos,
      titulo, autor, {key('titulo')} AS t, {key('autor')} AS a FROM lineas)"""
_PAIRS = f"""{_TRUTH}, leidos AS MATERIALIZED (SELECT modelo, foto_id, pos::INT AS pos,
      {key('titulo_corregido')} AS t, {key('autor_corregido')} AS a FROM detecciones),
    pares AS MATERIALIZED (SELECT d.modelo, e.foto_id, e.pos AS pe, d.pos AS pd, e.a AS ea, d.a AS da,
      len(list_intersect(list_distinct(string_split(e.t, ' ')),
          list_distinct(string_split(d.t, ' ')))) AS comunes
      FROM esperados e JOIN leidos d ON d.foto_id = e.foto_id
      WHERE d.t <> '' AND (contains(d.t, e.t) OR contains(e.t, d.t)
        OR len(list_intersect(list_distinct(string_split(e.t, ' ')),
            list_distinct(string_split(d.t, ' ')))) >= greatest(1.0::DOUBLE,
            0.6::DOUBLE * least(len(string_split(e.t, ' ')), len(string_split(d.t, ' '))))))"""
_CHOICE = f"""{_PAIRS}, fotos_leidas AS (SELECT r.modelo, r.foto_id,
        (SELECT count(*) FROM esperados e WHERE e.foto_id = r.foto_id) AS n
      FROM respuestas r WHERE legible),
    reparto(modelo, foto_id, n, pos, usados, elegido) AS (
      SELECT modelo, foto_id, n, -1, CAST([] AS INT[]), -1 FROM fotos_leidas
      UNION ALL
      SELECT modelo, foto_id, n, pos,
        CASE WHEN p IS NULL THEN usados ELSE list_append(usados, p) END, coalesce(p, -1)
      FROM (SELECT r.modelo, r.foto_id, r.n, r.pos + 1 AS pos, r.usados, min(q.pd) AS p
            FROM reparto r LEFT JOIN pares q ON q.foto_id = r.foto_id AND q.pe = r.pos + 1
              AND NOT list_contains(r.usados, q.pd)
            WHERE r.pos + 1 < r.n GROUP BY ALL))"""
define(
    "truth_flatten",
    ["lineas"],
    f""", {_TRUTH} SELECT CAST(foto_id AS VARCHAR) AS foto, pos, titulo, autor,
    autor <> '' AS autor_visible_en_foto FROM esperados""",
)
define(
    "title_match_pairs",
    ["detecciones"],
    f""", {_PAIRS} SELECT modelo, CAST(foto_id AS VARCHAR) AS foto, pe AS pos_esperado,
    pd AS pos_detectado, comunes::INT AS comunes FROM pares""",
)
define(
    "greedy_assignment",
    ["detecciones"],
    f""", {_CHOICE} SELECT modelo, CAST(foto_id AS VARCHAR) AS foto, pos AS pos_esperado, elegido
    FROM reparto WHERE pos >= 0""",
    recursive=True,
)
define(
    "extraction_scores",
    ["detecciones"],
    f""", {_CHOICE}, elegidos AS (SELECT r.modelo, r.foto_id, e.a AS ea, d.a AS da
        FROM reparto r JOIN esperados e ON e.foto_id = r.foto_id AND e.pos = r.pos
        JOIN leidos d ON d.foto_id = r.foto_id AND d.pos = r.elegido),
      bien AS (SELECT modelo, count(*) AS titulos_ok,
        count(*) FILTER (ea <> '' AND da <> '' AND (contains(ea, da) OR contains(da, ea)
            OR len(list_intersect(string_split(ea, ' '), string_split(da, ' '))) >= 1))
            AS autores_ok,
        count(*) FILTER (ea <> '') AS autores_total,
        count(*) FILTER (ea = '' AND da <> '') AS autores_inventados
        FROM elegidos GROUP BY modelo)
    SELECT r.modelo, b.titulos_ok, sum(len(r.libros))::BIGINT AS titulos_total, b.autores_ok,
      b.autores_total, b.autores_inventados,
      sum(CASE WHEN legible THEN len(r.libros) ELSE 0 END)::BIGINT AS libros_devueltos,
      count(*) FILTER (NOT legible) AS fotos_fallidas,
      round(sum(CASE WHEN legible THEN costo ELSE 0 END), 6) AS costo,
      round_even(sum(latencia_ms) / count(*), 0)::BIGINT AS latencia_media
    FROM respuestas r JOIN bien b ON b.modelo = r.modelo
    GROUP BY r.modelo, b.titulos_ok, b.autores_ok, b.autores_total, b.autores_inventados""",
    recursive=True,
)
_WIDE = "4611686018427387904"
_STUDY = f""", suma AS (SELECT modelo, foto_id, count(*) AS n,
        list_reduce(list_prepend(0.0::DOUBLE, list(confianza ORDER BY pos)), lambda a, b: a + b)
            / count(*) AS x,
        count(autor_descartado) AS frenados FROM detecciones GROUP BY modelo, foto_id),
    exacta AS (SELECT *, CAST(x * {_WIDE}::DOUBLE AS HUGEINT) * 100 AS m FROM suma),
    estudio AS (SELECT r.modelo, r.foto_id, legible AS ok, coalesce(n, 0)::INT AS cant_libros,
        coalesce((m // {_WIDE} + CASE WHEN m % {_WIDE} > 2305843009213693952
            OR (m % {_WIDE} = 2305843009213693952 AND (m // {_WIDE}) % 2 = 1)
            THEN 1 ELSE 0 END)::DOUBLE / 100, 0) AS confianza_media,
        coalesce(frenados, 0)::INT AS guardrail_disparado,
        CASE WHEN legible THEN r.costo ELSE 0 END AS costo, r.latencia_ms
      FROM respuestas r LEFT JOIN exacta e ON r.foto_id = e.foto_id)"""
define("image_metrics", ["detecciones"], f"{_STUDY} SELECT * FROM estudio")
define(
    "images_by_books",
    ["detecciones"],
    f"""{_STUDY} SELECT *, row_number() OVER (PARTITION BY modelo ORDER BY cant_libros, foto_id)
        AS puesto FROM estudio""",
)
define(
    "study_cost",
    ["respuestas"],
    "SELECT round(sum(costo), 6) AS costo_total FROM respuestas WHERE legible",
)
define(
    "guardrail_crosstab",
    ["detecciones"],
    f"""{_STUDY} SELECT CASE WHEN cant_libros < 2 THEN '<2' WHEN cant_libros = 2 THEN '2-2'
        WHEN cant_libros < 4 THEN '3-3' ELSE '>3' END AS banda, count(*) AS fotos,
    count(*) FILTER (cuota > 0.2) AS alto, count(*) FILTER (cuota > 0.1 AND cuota <= 0.2) AS medio,
    count(*) FILTER (cuota <= 0.1) AS bajo
    FROM (SELECT *, guardrail_disparado / greatest(cant_libros, 1) AS cuota FROM estudio)
    GROUP BY 1""",
)
define(
    "variant_results",
    ["detecciones"],
    f"""{_STUDY} SELECT (foto_id // 10) || '.jpg' AS foto, CASE foto_id % 10 % 5 WHEN 0 THEN 'original'
        WHEN 1 THEN 'bn' WHEN 2 THEN 'mas_contraste' WHEN 3 THEN 'mas_brillo' ELSE 'otra' END
        AS variante, modelo, cant_libros, confianza_media, ok FROM estudio""",
)

_CALLS = """SELECT *, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'vision_ok'
    WHEN event_type = 'signup' THEN 'lote_procesado' WHEN k % 3 = 0 THEN 'vision_fallo' END AS clase
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""
_CALL_ROWS = f"""SELECT clase,
    CASE WHEN clase <> 'lote_procesado' THEN k % 2 + 1 END AS intento,
    CASE WHEN clase <> 'lote_procesado' THEN 'modelo-' || (user_id % 4) END AS modelo,
    CASE clase WHEN 'vision_ok' THEN k * 10 + 500 WHEN 'vision_fallo' THEN k * 20 + 900 END
        AS latencia_ms,
    CASE clase WHEN 'vision_ok' THEN k + 1000 END AS tokens_entrada,
    CASE clase WHEN 'vision_ok' THEN k * 3 END AS tokens_salida,
    CASE clase WHEN 'vision_ok' THEN CAST('0.00' || (k % 9 + 1) AS DOUBLE) END AS costo,
    CASE clase WHEN 'lote_procesado' THEN event_id END AS lote_id,
    CASE clase WHEN 'lote_procesado' THEN user_id END AS libreria_id,
    CASE clase WHEN 'lote_procesado' THEN k % 40 END AS nuevos,
    CASE clase WHEN 'lote_procesado' THEN k % 7 END AS duplicados
    FROM ({_CALLS}) WHERE clase IS NOT NULL"""
STATEMENTS["call_log_rows"] = _CALL_ROWS
STATEMENTS["call_log_economics"] = f"""SELECT modelo, count(*) AS llamadas,
    count(*) FILTER (intento > 1) AS reintentos,
    count(*) FILTER (clase = 'vision_fallo') AS fallos,
    count(*) FILTER (clase = 'vision_fallo') / count(*) AS tasa_fallo,
    sum(latencia_ms) / count(*) AS latencia_media, max(latencia_ms) AS latencia_max,
    sum(tokens_entrada)::BIGINT AS tokens_entrada, sum(tokens_salida)::BIGINT AS tokens_salida,
    round(sum(costo), 6) AS costo FROM ({_CALL_ROWS}) WHERE modelo IS NOT NULL GROUP BY modelo"""
STATEMENTS["latency_percentiles"] = f"""SELECT modelo, quantile_disc(latencia_ms, 0.5)::BIGINT AS p50,
    quantile_disc(latencia_ms, 0.95)::BIGINT AS p95 FROM ({_CALL_ROWS}) WHERE modelo IS NOT NULL GROUP BY modelo"""
STATEMENTS["batch_costs"] = f"""SELECT count(*) FILTER (clase = 'lote_procesado') AS lotes,
    sum(nuevos)::BIGINT AS nuevos, sum(duplicados)::BIGINT AS duplicados,
    round(sum(costo) / count(*) FILTER (clase = 'lote_procesado'), 6) AS costo_por_lote
    FROM ({_CALL_ROWS})"""
STATEMENTS["exact_duplicate_docs"] = """SELECT doc_id, md5(text) AS huella,
    nullif(min(doc_id) OVER (PARTITION BY text), doc_id) AS duplicado_exacto_de FROM documents"""
STATEMENTS["unique_docs"] = """SELECT min(doc_id) AS doc_id, md5(text) AS huella
    FROM documents GROUP BY text"""

# --- streams ------------------------------------------------------------------------------

define(
    "stream_ingest",
    ["eventos_raw", "librerias"],
    f"""SELECT e.id, l.id AS libreria_id, tipo, payload, nullif(session_id, '') AS session_id
    FROM eventos_raw e JOIN librerias l ON l.slug = e.slug
    WHERE l.activa AND tipo IN {_PUBLIC_TYPES}""",
)
define(
    "stream_weekly",
    ["marcas"],
    f"SELECT * REPLACE (strftime(semana, '%Y-%m-%d') AS semana) FROM ({_WEEKS})",
)
_STRETCHES = f""", saltos AS (SELECT *, CASE WHEN creado_en - lag(creado_en) OVER w < INTERVAL 30 MINUTE
            THEN 0 ELSE 1 END AS salto FROM marcas WHERE session_id <> ''
        WINDOW w AS (PARTITION BY libreria_id, session_id ORDER BY creado_en, id)),
    tramos AS (SELECT *, sum(salto) OVER (PARTITION BY libreria_id, session_id
        ORDER BY creado_en, id) AS tramo FROM saltos),
    cerrados AS (SELECT libreria_id, session_id, tramo, min(creado_en) AS inicio,
        max(creado_en) + INTERVAL 30 MINUTE AS cierre, count(*) AS eventos,
        count(*) FILTER (tipo = 'busqueda') AS busquedas,
        count(*) FILTER (tipo = 'clic_whatsapp') AS clics FROM tramos GROUP BY 1, 2, 3)
    SELECT libreria_id, session_id, {stamp('inicio')} AS inicio, {stamp('cierre')} AS cierre,
    eventos, busquedas, clics"""
define(
    "stream_sessions",
    ["marcas"],
    f"""{_STRETCHES}, cierre <= (SELECT max(creado_en) FROM marcas WHERE session_id <> '')
        - INTERVAL 1 HOUR AS cerrada FROM cerrados""",
)
define("stream_sessions_late", ["marcas"], f"{_STRETCHES} FROM cerrados")
define(
    "stream_progress",
    ["lineas"],
    """SELECT lote_id, count(*) FILTER (NOT repetido) AS libros,
    count(*) FILTER (repetido) AS duplicados, count(DISTINCT foto_id)::INT AS fotos_listas
    FROM (SELECT *, estado = 'descartado' AND l_partkey % 2 = 0 AS repetido FROM lineas)
    GROUP BY lote_id""",
)

# --- stored tables and results ------------------------------------------------------------

define(
    "stored_tables",
    ["libros"],
    f"""SELECT id, libreria_id, lote_id, titulo, autor, estado, duplicado_de,
    {stamp('creado_en')} AS creado_en, {stamp('archivado_en')} AS archivado_en FROM libros""",
)
STATEMENTS["stored_results"] = STATEMENTS["image_metrics"]
