-- The four KPIs as query texts. Parameters: :excluded (statuses), :min_orders, :low_score, :top_k.

-- name: repeat_purchase_rate
WITH per_person AS (
  SELECT customer_unique_id, count(*) AS n
  FROM orders JOIN customers USING (customer_id)
  WHERE NOT array_contains(:excluded, order_status)
  GROUP BY customer_unique_id)
SELECT count(*) AS total_customers,
       count_if(n > 1) AS repeat_customers,
       CAST(round(try_divide(CAST(100 * count_if(n > 1) AS DECIMAL(24, 0)), count(*)), 2) AS DOUBLE) AS repeat_purchase_rate_pct
FROM per_person;

-- name: cohort_retention
WITH active AS (
  SELECT DISTINCT customer_unique_id AS person, CAST(trunc(CAST(order_purchase_timestamp AS DATE), 'MONTH') AS TIMESTAMP_NTZ) AS month
  FROM orders JOIN customers USING (customer_id)
  WHERE NOT array_contains(:excluded, order_status) AND customer_unique_id IS NOT NULL),
since AS (SELECT person, month, min(month) OVER (PARTITION BY person) AS cohort_month FROM active),
counted AS (
  SELECT cohort_month,
         (year(month) - year(cohort_month)) * 12 + month(month) - month(cohort_month) AS month_number,
         count(*) AS active_customers
  FROM since WHERE cohort_month IS NOT NULL
  GROUP BY 1, 2),
sized AS (SELECT *, max(CASE WHEN month_number = 0 THEN active_customers END) OVER (PARTITION BY cohort_month) AS cohort_size FROM counted)
SELECT cohort_month, month_number, active_customers, cohort_size,
       CAST(round(CAST(100 * active_customers AS DECIMAL(24, 0)) / cohort_size, 2) AS DOUBLE) AS retention_pct
FROM sized
ORDER BY cohort_month, month_number;

-- name: customer_lifetime_value
WITH basket AS (SELECT order_id, sum(price + freight_value) AS worth FROM order_items GROUP BY order_id),
spend AS (
  SELECT customer_unique_id, count(*) AS n, sum(worth) AS spent
  FROM orders JOIN customers USING (customer_id) JOIN basket USING (order_id)
  WHERE NOT array_contains(:excluded, order_status)
  GROUP BY customer_unique_id)
SELECT CAST(round(sum(spent) / count(spent), 2) AS DOUBLE) AS avg_clv_all,
       CAST(round(try_divide(sum(spent) FILTER (WHERE n = 1), count(spent) FILTER (WHERE n = 1)), 2) AS DOUBLE) AS avg_clv_one_time_buyers,
       CAST(round(try_divide(sum(spent) FILTER (WHERE n > 1), count(spent) FILTER (WHERE n > 1)), 2) AS DOUBLE) AS avg_clv_repeat_buyers
FROM spend;

-- name: category_dissatisfaction
/* A review counts once for each item of its order; a score that is
   missing counts for the orders alone; a semicolon in a comment ends nothing. */
WITH pieces AS (
  SELECT i.order_id, product_category_name_english AS category, count(*) AS weight
  FROM order_items i JOIN products p ON p.product_id = i.product_id
       LEFT JOIN category_translation c ON c.product_category_name = p.product_category_name
  GROUP BY i.order_id, product_category_name_english),
marks AS (
  SELECT order_id, count(review_score) AS scored, sum(review_score) AS points, count_if(review_score <= :low_score) AS low
  FROM order_reviews GROUP BY order_id),
weighed AS (
  SELECT category, count(*) AS num_orders, sum(weight * scored) AS scored, sum(weight * points) AS points, sum(weight * low) AS low
  FROM pieces LEFT SEMI JOIN (SELECT order_id FROM orders WHERE NOT array_contains(:excluded, order_status)) o
       ON o.order_id = pieces.order_id LEFT JOIN marks ON marks.order_id = pieces.order_id
  GROUP BY category)
SELECT category, num_orders,
       CAST(round(try_divide(CAST(points AS DECIMAL(24, 0)), scored), 2) AS DOUBLE) AS avg_review_score,
       CAST(round(try_divide(CAST(100 * low AS DECIMAL(24, 0)), scored), 2) AS DOUBLE) AS pct_low_reviews
FROM weighed
WHERE num_orders > :min_orders
ORDER BY pct_low_reviews DESC NULLS FIRST, category ASC NULLS LAST
LIMIT :top_k;
