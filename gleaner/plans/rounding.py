"""Columns of type double of the registered queries; both engines round them to six places, as sums depend on order."""

ROUNDED = {
    "agg01_group_moments": "mean median sd",
    "agg02_describe": "high low mean q1 q2 q3 sd",
    "agg05_crosstab_share": "lang_de lang_en lang_fr",
    "agg06_prevalence": "share",
    "agg08_monthly_series": "mean",
    "agg09_grouping_sets": "mean",
    "agg12_agg07_means_by_entity": "discount quantity tax",
    "agg16_rates": "rate",
    "agg17_totals_from_means": "total",
    "agg18_dat01_weekly_share": "share",
    "agg19_win03_peak_baseline": "ratio",
    "agg20_share_yes": "share_yes",
    "agg21_agg23_agreement_by_bucket": "agreement",
    "agg22_downgrade_rate": "high low rate",
    "fig18_its_fitted": "mean fitted",
    "sta16_clustered_errors": "coef se low high",
    "fig05_frame_heat_map": "legal narrative technical",
    "flagship_group_contrast": "d df difference mean1 mean2 p t var1 var2",
    "mdl01_mdl06_model_plug_in": "score",
    "mdl02_mean_over_windows": "score",
    "mdl03_stance": "stance",
    "mdl04_document_sentiment": "sentiment",
    "mdl05_frames": "frame_legal frame_narrative frame_technical",
    "sta13_fisher_exact": "odds p",
    "fig01_quartiles_histogram": "q1 q2 q3",
    "fig02_fig06_group_means": "mean se",
    "fig04_fig17_monthly_by_group": "mean",
    "fig10_kernel_density": "density",
    "view_wilson": "low high",
    "fig07_agg11_prevalence_difference": "difference",
    "fig08_fig09_normalised_mix": "share",
    "jon07_sta21_controlled_difference": "difference",
    "mth01_mth03_numbers": "clipped even ratio",
    "mth02_cohen_h": "h",
    "prj07_prefix_columns": "l_discount l_extendedprice l_quantity l_tax",
    "prj09_group_split": "chars_good",
    "prj11_safe_numeric": "k none",
    "prj16_quadrants": "share",
    "sco02_keyword_component": "score",
    "sco03_composite_renorm": "composite",
    "sco07_sco08_theme_validation": "score",
    "sco09_indicator_score": "score",
    "src05_snk03_jsonl": "value",
    "sta01_sta02_welch_cohen": "d df difference p t",
    "sta03_sta04_sta35_rank_tests": "auc delta p u",
    "sta09_win06_bh_adjust": "p_bh",
    "sta10_sta12_chi2_cramers": "chi2 cramers_v p",
    "sta11_fig12_yates_risk_ratio": "chi2 p risk_ratio",
    "sta14_pearson_pairs": "p r",
    "sta14_pearson_unrelated": "p r",
    "sta01_sta09_contrasts_adjusted": "p p_bh",
    "sta15_spearman": "rho",
    "sta16_fig11_factor_ols": "coef se t r2 p",
    "sta16_ols_coefficients": "intercept slope",
    "sta17_its_design": "mean",
    "sta17_its_normal_equations": "b0 b1 s00 s01 s02 s03",
    "sta17_sta18_hac_errors": "coef p se",
    "sta07_sta08_tost": "bound difference p",
    "sta20_durbin_watson": "dw",
    "sta22_pre_post_contrast": "d df difference p t",
    "sta23_fig15_quarterly_effect": "d df difference p t",
    "sta24_sta40_leave_one_out": "d df difference p t",
    "sta25_weighting_variants": "mean",
    "sta26_zero_inflation": "mean_nonzero share_zero",
    "sta27_fig03_paired_contrast": "d df difference p t",
    "sta28_sta29_sta30_sensitivity": "d df difference p t",
    "sta31_kappa_fixed_labels": "kappa",
    "sta31_sta34_kappa": "agreement kappa",
    "sta35_auc": "auc delta p u",
    "sta36_sta38_wilson": "high low",
    "sta37_threshold_recall": "precision recall",
    "top01_exemplars": "o_totalprice",
    "sta39_agreement": "share",
    "txt34_centrality": "density plain subject total",
    "txt09_fraction_quoted": "share",
    "txt16_frame_fraction": "frame_legal frame_narrative frame_technical",
    "txt24_overlap": "score",
    "win01_centred_weighted_mean": "smooth",
    "win02_rolling7": "smooth",
}
